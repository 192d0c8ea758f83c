import regex

from nomina.llm import licences
from nomina.llm.licences import scan
from tests.llm.conftest import nasty_documents, prose, write, DOCUMENTS


def test_notices_in_nasty_rows(spark, tmp_path):
    extra = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to deal in the Software without restriction"]
    rows = nasty_documents()
    rows += [(9000 + i, f"{prose(50 + i, 20)}\n\n  {t}\n{prose(80 + i, 20)}", "en", "s1", 0, "", 0, "", 0.0, "") for i, t in enumerate(extra)]
    rows += [(9100, "\n".join(extra[:3]), "en", "s1", 0, "", 0, "", 0.0, ""), (9101, "the licence of the city to build under the terms of the council", "en", "s1", 0, "", 0, "", 0.0, "")]
    write(tmp_path, "documents", rows, DOCUMENTS)
    got = scan(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert len(got) == len(rows)
    found = {r["_id"]: (r["n_licences"], r["families"]) for r in got if r["n_licences"]}
    assert found == {9000: (1, ["apache"]), 9001: (1, ["mit"]), 9002: (1, ["cc-by-nc"]), 9003: (1, ["gpl"]), 9004: (1, ["mit"]), 9100: (3, ["apache", "cc-by-nc", "mit"])}
    n = {r["_id"]: r["n_paragraphs"] for r in got}
    assert n[9100] == 3 and n[0] == 0 and n[9000] == 3


def test_a_notice_inside_one_long_line(spark):
    notices = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License."]
    rows = [(i, f"{prose(200 + i, 60)} {t} {prose(300 + i, 60)}") for i, t in enumerate(notices)] + [(9, prose(5, 150))]
    got = {r["_id"]: r["families"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ["apache"], 1: ["mit"], 9: []}


def test_everything_but_the_scores_by_hand(spark, sf_small):
    """Paragraphs, the calibrated bar, the comparison with the notices and the sums over a
    document, recomputed in Python from the classifier's scores."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    model, least = licences.train(docs, "doc_id", "text")
    scored = licences.predict(model, licences.paragraphs(docs, "doc_id", "text").withColumn("words", licences.tokens(licences.F.coalesce("paragraph", licences.F.lit("")))))
    scores = {}
    for r in scored.select("paragraph", "family", "family_p").collect():
        scores[r.paragraph] = (r.family, r.family_p)

    def told(text):
        w = [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
        return {" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))}

    known = {f: [told(n) for n in ns] for f, ns in licences.NOTICES.items()}
    want = {}
    for r in docs.collect():
        paragraphs = [p for p in (r.text or "").split("\n") if p.strip(" ")]
        found = []
        for i, p in enumerate(paragraphs):
            family, score = scores[p]
            if score >= least:
                own = told(p)
                if any(100 * len(own & t) >= licences.CONFIRM * min(len(own), len(t)) for t in known[family]):
                    found.append((i, family))
        want[r.doc_id] = (len(paragraphs), len(found), sorted({f for _, f in found}))
    got = {r["_id"]: (r["n_paragraphs"], r["n_licences"], r["families"]) for r in scan(docs).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_every_paragraph_is_learned_from_and_calibrated_with(spark, monkeypatch):
    fitted, ranked = [], []

    class Seen(licences.LogisticRegression):
        def fit(self, rows):
            fitted.append(rows.where("label = 0").count())
            return super().fit(rows)

    exact = licences.percentile
    monkeypatch.setattr(licences, "LogisticRegression", Seen)
    monkeypatch.setattr(licences, "percentile", lambda values, share: ranked.append(values.count()) or exact(values, share), raising=False)
    docs = spark.range(13_000).selectExpr("id as doc_id", "concat('the source of entry ', id, ' and this text', if(id = 7, '\\nRedistributions of source code must retain', '')) as text")
    licences.train(docs, "doc_id", "text")
    assert fitted == [13_000] and ranked[0] == 13_000


def test_percentile_is_exact(spark):
    rows = spark.range(20_000).select((licences.F.pow(licences.F.rand(3), 9) * licences.F.when(licences.F.col("id") % 3 > 0, 1.0).otherwise(0.0)).alias("p")).cache()
    for share in (0.0, 0.05, 0.5, 0.9995, 1.0):
        want = rows.agg(licences.F.expr(f"percentile(p, {share})")).first()[0]
        assert abs(licences.percentile(rows, share) - want) < 1e-12
    assert licences.percentile(rows.where("p > 2"), 0.5) is None
