"""Small tables with everything that goes wrong, and the comparison with DuckDB."""

import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
                       ("n_words", pa.string()), ("shard", pa.int32()), ("kept", pa.string()), ("size", pa.float64()), ("fp", pa.string())])
BENCHMARK = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("fp", pa.string())])
CONVERSATIONS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("depth", pa.string()), ("node", pa.float64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])


def prose(seed: int, n: int, of: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(of)}x{r.randrange(9)}" for _ in range(n))


def nasty_documents() -> list[tuple]:
    base, item = prose(1, 120), prose(7, 40)
    words = base.split()
    near = [" ".join(words[:i] + [f"new{i}"] + words[i + 1:]) for i in (10, 60, 110)]
    texts = [None, "", "   \n\t ", "a", "A a", "one two three", "One Two Three", base, base, base.upper(), *near, f"{near[0]} more",
             prose(2, 30) + "\n" + prose(2, 30) + "\n\n" + prose(3, 4), "x " * 50, "##$$ %% " * 30, "é ñ\u001c ü   ß" * 9,
             prose(4, 60) + " " + item, item, "short item here", "say SHORT, item-here! now", prose(5, 300) + " lone", "lone", prose(6, 30_000, 10**6), "\n".join([prose(8, 12)] * 5)]
    rows = [(i * 3, t, ("en", "fr", None)[i % 3], ("s1", "s2", "s3", None)[i % 4]) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[0], (None, base, "en", "s1"), (None, None, None, None), (500, base, "fr", None), (21, "same id, other text " + prose(9, 25), "en", "s2")]
    return [(*r, 0 if r[1] is None else len(r[1]), "clash", 3, "no", 0.5, "x") for r in rows]


def nasty_benchmark() -> list[tuple]:
    return [(1, prose(7, 40), "x"), (10, prose(7, 40), "x"), (2, "Short item; here", "x"), (3, "lone", "x"), (4, None, "x"), (5, " . ", "x"),
            (6, " ".join(prose(7, 40).split()[5:18]), "x"), (6, "a", "x"), (7, prose(77, 13), "x")]


def nasty_conversations() -> list[tuple]:
    r = random.Random(5)
    rows = [(c, t, ("user", "assistant")[t % 2], prose(c % 7 * 31 + t * (c % 3 > 0), 3 + t)) for c in range(70) for t in range(r.randrange(1, 7))]
    rows += [(20, None, "user", "null turn first"), (20, 0, None, None), (20, 0, "", ""), (20, 0, "user", ""), (20, 0, "user", "")]  # ties and repeats
    rows += [(None, 0, "user", "of no conversation"), (None, None, None, None), (-7, 0, "user", "below zero"), (-7, 1, "user", "é ü ß"), (10**15 + 3, 4, "user", "far")]
    rows += [(40, t, "user", prose(t % 11, 5)) for t in range(10, 60)] + [(200 + c, 0, "user", "same first turn") for c in range(40)]
    rows += [(500, 0, "user", prose(3, 20_000))]
    return [(*x, "clash", 1.5) for x in rows]


def write(path, name: str, rows: list[tuple], schema: pa.Schema) -> pa.Table:
    t = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
    pq.write_table(t, f"{path}/{name}.parquet")
    return t


@pytest.fixture(scope="session")
def nasty(tmp_path_factory):
    d = tmp_path_factory.mktemp("nasty")
    write(d, "documents", nasty_documents(), DOCUMENTS)
    write(d, "benchmark", nasty_benchmark(), BENCHMARK)
    write(d, "labels", [(3, 1, 0), (9, 1, None), (None, 1, 1), (21, 0, 1), (21, 0, 0), (30, 1, 0)], LABELS)
    write(d, "conversations", nasty_conversations(), CONVERSATIONS)
    return str(d)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCUMENTS), ("benchmark", BENCHMARK), ("labels", LABELS), ("conversations", CONVERSATIONS)):
        write(d, name, [], schema)
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), f"{d}/pages.parquet")
    return str(d)


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return int(v) if hasattr(v, "__index__") or isinstance(v, float) and v.is_integer() or type(v).__name__ == "bool_" else v


def rows_of(frame) -> list[str]:
    return sorted(str(tuple(map(_plain, row))) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.execute(sql).df()
