"""The pipeline's stages on a small table, against plain Python."""

import corpus_pipeline
from gamelode.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    w = quality.train(docs)
    kept = {i for i, r in rows.items() if quality.score(r.text.encode(), w) >= quality.THRESHOLD}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality classifier"](spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns

    last = {}
    for i in sorted(kept):
        last[rows[i].text.encode().lower()] = i
    two = stages["exact dedup"](spark, one, SF)
    assert {r.doc_id for r in two.collect()} == set(last.values())

    three = stages["SimHash near-dedup"](spark, two, SF)
    ids = sorted(last.values())
    fp = {i: simhash.fingerprint(rows[i].text.encode(), 5) for i in ids}
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fp[i] ^ fp[j]).bit_count() <= 4 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    assert {r.doc_id for r in three.collect()} == set(group.values())

    four = stages["mixing sources"](spark, three, SF)
    assert four.columns == docs.columns
    text = {}
    for r in four.collect():
        text.setdefault(r.doc_id, []).append(r.text)
    assert all(len(v) <= 3 for v in text.values())
    five = stages["piece encoding"](spark, four, SF)
    assert five.count() == four.count() and five.where("NOT lossless").count() == 0


def test_odd_tables(spark):
    """Nulls, empty and repeated rows, repeated ids, columns that clash with inner names, no rows at all."""
    text = " ".join(f"word{i % 37} of the" for i in range(60))
    rows = [(1, text, "en", "a", 9, "x"), (1, text, "en", "a", 9, "x"), (1, text + " more", "en", "a", 9, "x"), (2, None, None, None, None, "x"), (3, "", "en", "", 0, None), (None, text.upper(), "en", "b", 1, "x"), (4, "the end", "en", "b", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, d = d, stage(spark, d, SF)
            if name != "piece encoding":
                assert d.columns == before.columns
        out = d.collect()
        assert all(r.lossless for r in out)
    assert out == []
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()}
    assert kept == {1, 3, 4}  # of null and empty the larger id, of equal texts the one with an id
