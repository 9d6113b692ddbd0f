import random

import corpus_pipeline as P
from webstrata.llm import mixing, packing


def corpus():
    rng = random.Random(8)
    langs = {"en": "the of and thing with from that under over some", "de": "der und schön nicht ein für über auch mit nach"}
    words = {k: v.split() + ["".join(rng.choice("abdegilmnorstu") for _ in range(6)) for _ in range(400)] for k, v in langs.items()}
    passage = " ".join(rng.choices(words["en"], k=60))
    rows = [(i, " ".join(rng.choices(words[k], k=120)), k, f"s{i % 3}", 1) for i in range(120) for k in [rng.choice(list(langs))]]
    near = rows[5][1].split()
    near[60] = "zzz"
    rows += [(200, rows[3][1], rows[3][2], "s0", 1), (201, " ".join(near), rows[5][2], "s1", 1), (202, "12 34 !!", "en", "s2", 1), (203, None, None, None, None), (204, "", "en", "s0", 0)]
    return rows + [(300 + i, " ".join(rng.choices(words["en"], k=40)) + " " + passage + " the of and", "en", "s1", 1) for i in range(3)], passage


def test_each_stage_against_what_is_planted(spark, tmp_path):
    rows, passage = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert name == "best_fit_packing" or docs.columns == P.COLUMNS
    ids = {n: {r.doc_id for r in k} for n, k in kept.items()}
    everything = {r[0] for r in rows}
    assert ids["language_id"] == everything - {202, 203, 204}
    assert ids["simhash_near_dedup"] == ids["language_id"] - {200, 201}
    texts, before = {r.doc_id: r.text for r in kept["substring_dedup"]}, dict((r[0], r[1]) for r in rows)
    assert texts.keys() == ids["simhash_near_dedup"] and all(passage not in texts[k] for k in (301, 302)) and all(texts[k] == before[k] for k in texts if k < 301)
    # mixing draws what its own SQL-checked operator draws; packing is whole
    again = mixing.mix(spark.read.parquet(str(tmp_path / "substring_dedup"))).select("doc_id").collect()
    assert sorted(r.doc_id for r in again) == sorted(r.doc_id for r in kept["mix_sources"])
    pieces = kept["best_fit_packing"]
    assert sum(r.piece == 0 for r in pieces) == len(kept["mix_sources"]) and max(r.offset + r.length for r in pieces) <= packing.CAPACITY


def test_run_and_empty(spark, tmp_path):
    rows, _ = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "some")).count() > 50
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def test_rows_without_ids_of_their_own(spark, tmp_path):
    """Null and repeated ids, clashing columns, a lazy result of another operator in the same session."""
    from webstrata.llm import simhash

    rows, _ = corpus()
    rows = [(None if i % 3 == 0 else 7, *r[1:], "x", "y") for i, r in enumerate(rows[:60])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy string, lang_pred string"
    docs = spark.createDataFrame(rows, schema)
    other = simhash.near_duplicates(docs)
    kept = {}
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
    assert kept["language_id"] == kept["simhash_near_dedup"] == kept["substring_dedup"] == 60
    assert other.count() == 60


def test_runs_leave_each_other_alone(spark, tmp_path, monkeypatch):
    """Two lazy results are both readable, and within a run a stage's tables go when the next begins."""
    from webstrata.llm.common import WRITTEN, cut

    spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    working = P.stage(lambda s, docs, path: cut(docs))
    monkeypatch.setattr(P, "STAGES", [("one", working), ("two", working), ("three", working)])
    before = len(WRITTEN)
    one = P.run(spark, str(tmp_path))
    assert one.count() == 1
    two = P.run(spark, str(tmp_path))
    assert one.count() == two.count() == 1
    owners = [o for o in WRITTEN if o.startswith("stages of")]
    assert len(owners) >= 2 and all(len(WRITTEN[o]) == 1 for o in owners[-2:]) and len(WRITTEN) >= before
    by_itself = working(spark, spark.range(1), "")
    assert by_itself.count() == 1 and one.count() == 1
