"""The pipeline's stages in order, each over all that its predecessor kept."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from leafwise.llm import bpe, pii, simhash


def test_stages(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    held, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, source)
        if name != "byte_bpe":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        held = frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    known = frames["language_id"]
    assert 0.9 * docs.count() < known.count() <= docs.count()
    single = frames["simhash_near_dedup"]
    classes = {r[0] for r in simhash.near_duplicates(known).select("component_id").distinct().collect()}
    assert ids(single) <= classes and len(ids(single)) >= 0.9 * len(classes)
    clean = frames["pii"]
    assert ids(clean) == ids(single) and clean.where("text rlike '[a-z]@[a-z]+[.][a-z]'").count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert ids(frames["source_mix"]) <= set(texts)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in frames["byte_bpe"].collect():
        assert r.round_trip and r.ids == plain.encode_ordinary(texts[r.doc_id])
    assert frames["byte_bpe"].count() == frames["source_mix"].count()
    assert pii.BASE


EDGES = "doc_id bigint, text string, lang string, source string, n_chars bigint, rejected string, lang_pred int, __n int, Score double, ids string"
WORDS = "the old house of the river and a small boat that was for sale near this bridge in the town".split()


def edge_rows():
    line = lambda k: " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + "aeiou"[(k + i) % 5] for i in range(60))
    made = [(k, line(k), "en", ["a", "b", None][k % 3], 1, "r", 1, 2, 0.5, "i") for k in range(40)]
    same = made[3]
    extra = [(100, None, "en", "a", None, None, None, None, None, None), (101, "", None, "a", 0, None, None, None, None, None), (102, "12 34", "en", None, 5, None, None, None, None, None), (103, same[1], "en", "b", 2, None, None, None, None, None), (104, "write to a.b@mail.org " + made[5][1], "en", "b", 2, None, None, None, None, None), (105, (line(6) + " ") * 1500, "en", "c", 2, None, None, None, None, None), (None, line(50), None, None, None, None, None, None, None, None)]
    return [*made, same, *extra]


def test_edges_of_every_stage(spark, tmp_path):
    docs = spark.createDataFrame(edge_rows(), EDGES)
    held, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, "")
        out.write.parquet(f"{tmp_path}/{name}")
        held = frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "byte_bpe":
            assert held.columns == docs.columns
    known = {r.doc_id for r in frames["language_id"].collect()}
    assert known >= set(range(40)) | {103, 104, None} and not known & {100, 101, 102}
    single = [r.doc_id for r in frames["simhash_near_dedup"].collect()]
    assert 3 in single and 103 not in single
    held = {r[0]: r[1].split() for r in edge_rows() if r[0] in known}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in held.items()}
    earlier = [k for k in sets if k is not None]  # a null id comes last
    assert None in single or any(len(sets[k] & sets[None]) >= 0.8 * len(sets[k] | sets[None]) for k in earlier)
    clean = {r.doc_id: r for r in frames["pii"].collect()}
    assert all(r.n_chars == len(r.text) for r in clean.values()) and "a.b@mail.org" not in str(clean)
    assert frames["byte_bpe"].count() == frames["source_mix"].count() and frames["byte_bpe"].where("not round_trip").count() == 0


def test_stages_take_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame(edge_rows(), EDGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        got = stage(spark, docs, "").count()
        assert got == docs.count() if name in ("pii", "byte_bpe") else got > 0, name
