"""Tournaments, plans, adapters, the command line, streams and the kernels beside their expressions."""

import json
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkspark import streaming
from chunkspark.__main__ import main
from chunkspark.operators import chunkers as C
from chunkspark.operators import dedup as D
from chunkspark.operators import judge
from chunkspark.operators import overlap as O
from chunkspark.operators import qa
from chunkspark.operators import quality as Q
from chunkspark.operators import retrieve
from chunkspark.operators import splitters as S
from chunkspark.operators.embed import FunctionEncoder, HttpEncoder
from chunkspark.plans.config import Config, PostProcessing, ProxyConfig, SafetyConstraints
from chunkspark.plans.plan import HaystackComponent, LangChainSplitter, LlamaIndexParser, Plan
from chunkspark.plans.tournament import Candidate, ChunkOptimizer, post_process
from chunkspark.sources.documents import from_table, list_files, load_documents

BODY = " ".join(f"Fact {i} is about item{i} and thing{i}." for i in range(40))


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")


def test_quality_kernel_says_what_the_expressions_say(spark):
    texts = [None, "", "  ", "One.", "It was above. See below! And so?", "First a thing. Then. second to none,", "very very really good, but", "(a) " * 40, BODY, "he said", "1.5 and 2.x were 1. a", "Öl über é. Zwei.\n\nDrei als mentioned as mentioned."]
    t = F.col("text")
    rows = docs(spark, *texts).select("text", Q.completeness(t).alias("c"), Q.density(t).alias("d"), Q.boundaries(t).alias("b"), Q.lexical_coherence(t).alias("l")).collect()
    for r in rows:
        if r.text is not None:
            assert np.allclose(Q.dimensions(r.text)[:4], (r.c, r.d, r.b, r.l)), r.text
    assert Q.dimensions(None) == Q.dimensions("")
    assert Q.score(docs(spark, *texts).withColumnRenamed("id", "chunk_id")).count() == len(texts)


def test_splitting_without_recursion():
    deep = tuple(chr(0x4E00 + k) for k in range(3000))  # more separators than the stack holds
    text = "word " * 30 + "".join(deep)
    assert "".join(S.recursive_pieces(text, 8, 0, deep)).replace(" ", "") == text.replace(" ", "")
    assert S.recursive_pieces("a b c d e f", 2, 0, ("|",)) == S.token_pieces("a b c d e f", 2, 0) == ["a ", "b ", "c ", "d ", "e ", "f"]
    assert [m["start_index"] for _, m in S.recursive("one two. three four. five six.", 3, 0, add_start_index=True)] == [0, 9, 21]


def test_retrieval_ways_agree(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    v[50:55] = v[0]
    c = spark.createDataFrame([(f"c{i:03d}", x.tolist()) for i, x in enumerate(v)], "chunk_id string, vec array<float>").repartition(3)
    q = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(v[:9])], "qid string, vec array<float>")
    sims = np.round(v[:9].astype(np.float64) @ v.astype(np.float64).T, 6)
    want = {(f"q{i}", r + 1): f"c{j:03d}" for i in range(9) for r, j in enumerate(sorted(range(200), key=lambda j: (-sims[i, j], j))[:6])}
    for most in (1 << 20, 0):
        assert {(r.qid, r["rank"]): r.chunk_id for r in retrieve.search(c, q, 6, group_rows=64, most_bytes=most).collect()} == want
    assert retrieve.search(c, q.limit(0)).count() == 0 and retrieve.search(c.limit(0), q).count() == 0


def test_blocks_travel_without_copies(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(300, 8)), 1).astype(np.float32)
    v[40:60], v[100] = v[3], 0  # equal vectors and one without a direction
    c = spark.createDataFrame([(f"c{i:03d}", x.tolist()) for i, x in enumerate(v)], "chunk_id string, vec array<float>").repartition(5)
    q = spark.createDataFrame([(f"q{i:03d}", v[i % 120].tolist()) for i in range(240)], "qid string, vec array<float>")
    sims = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 6)
    best = [sorted(range(300), key=lambda j: (-sims[i, j], j))[:7] for i in range(120)]
    # blocks of 40 chunks, so that lists go through several
    found = retrieve.search(c, q, 7, group_rows=50, most_bytes=0, block_bytes=40 * 8 * 4)
    assert {(r.qid, r["rank"]): (r.chunk_id, r.sim) for r in found.collect()} == {(f"q{i:03d}", n + 1): (f"c{j:03d}", sims[i % 120, j]) for i in range(240) for n, j in enumerate(best[i % 120])}
    plan = found._jdf.queryExecution().toString()
    assert "sequence(" not in plan  # neither side is repeated for the other's groups


def test_chunks_leave_in_small_batches(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    made, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *rest: (made.append(f), real(self, f, *rest))[1])
    C.parent_child(docs(spark, BODY))
    texts = ["word " * 20000 + "end."] * 60  # 6 MB, many chunks each
    batches = made[0](iter([pa.record_batch({"doc_id": [str(i) for i in range(60)], "text": texts})]))
    sizes = [(b.num_rows, b.nbytes) for b in batches]
    assert sum(n for n, _ in sizes) == 60 * len(S.parent_child("0", texts[0], (1000, 200))) and max(x for _, x in sizes) < 2 << 20


def test_near_sets_share_a_signature(spark):
    rng, sets = np.random.default_rng(8), []
    for n in [1, 2, 5, 13, 40, 150, 600] * 20:
        base = rng.integers(-(2**63), 2**63 - 1, n)
        for drop in (0, n // 30, n // 8):
            sets.append(np.unique(np.concatenate((base[drop:], rng.integers(-(2**63), 2**63 - 1, n // 40)))))
    sizes, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
    for threshold in (0.6, 0.85, 0.95):
        signature, owner = D.signatures(flat, sizes, threshold)
        of = [set(signature[owner == k].tolist()) for k in range(len(sets))]
        i, j, similarity = D.near_rows(flat, sizes, threshold)
        assert len(i) > 100 and all(of[a] & of[b] for a, b in zip(i, j, strict=True))
        assert all(s == len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b, s in zip(i[:50], j, similarity, strict=False))
    texts = docs(spark, "one two three four five", "one two three four five", "x one two three four five", "a b", "").withColumnRenamed("id", "chunk_id")
    for threshold in (0.5, 0.9):  # equal texts, near ones, and those without n-grams
        pairs = D.jaccard_pairs(texts, D.word_ngrams(F.col("text")), threshold)
        assert {(r.a, r.b) for r in pairs.collect()} == ({("0", "1"), ("0", "2"), ("1", "2")} if threshold == 0.5 else {("0", "1")})
        whole = {(r.id, r.root) for r in D.jaccard_components(texts, D.word_ngrams(F.col("text")), threshold).collect()}
        assert whole == {(r.id, r.root) for r in D.components(pairs).collect()}


def test_shingles_take_no_walk_for_each(spark):
    long = "äb" * 60_000 + "c\U0001f600d"  # a walk from the start for each character would take minutes
    began = time.time()
    got = spark.createDataFrame([(long,), ("ab",)], "text string").select(D.shingles(F.col("text")).alias("s")).collect()
    assert set(got[0].s) == {long[k : k + 3] for k in range(len(long) - 2)} and got[1].s == [] and time.time() - began < 20


def test_hashing_keeps_texts_in_their_tasks(spark):
    from chunkspark.functions import vectors as V

    d = spark.createDataFrame([(k, f"w{k} b a b. C w{k % 3} d. E") for k in range(40)] + [(50, None), (51, " "), (52, "x\x1cy z")], "id int, text string")
    rows = V.hashing_sparse(d, "id", F.col("text"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    again = d.unionByName(d.where("id < 3"))  # rows with one id are one text
    for df in (d, again):
        named = df.withColumn("__text", F.col("text"))
        want = {(r.id, r.idx, r.v) for r in V._sparse_shuffled(named, "id", F.col("text"), 256).collect()}
        got = V.hashing_sparse(df, "id", F.col("text")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        old = {(r.id, round(r.coherence, 9)) for r in Q._coherence_shuffled(df, "id", "text", 256).collect()}
        assert {(r.id, round(r.coherence, 9)) for r in Q.embedding_coherence(df, "id").collect()} == old
        hits = retrieve.search_sparse(*(V.hashing_sparse(x, "id", F.col("text")).withColumnRenamed("id", n) for x, n in ((df, "chunk_id"), (d.limit(9), "qid"))), 4)
        rest = retrieve.search_common(*(V.hashing_dense(x, "id", F.col("text")).withColumnRenamed("id", n) for x, n in ((df, "chunk_id"), (d.limit(9), "qid"))), 4, block_bytes=4 * 256 * 8)
        assert {tuple(r) for r in rest.collect()} == {tuple(r) for r in hits.collect()}


def test_one_bad_candidate_does_not_stop_the_rest(spark, monkeypatch):
    d = from_table(docs(spark, BODY, BODY.replace("Fact", "Note")))
    o = ChunkOptimizer(Config(safety=SafetyConstraints(max_chunks_per_doc=5)))
    found = [Candidate("fixed_length", "good", {"base_token_size": 512, "overlap": 0}), Candidate("no_such_chunker", "bad", {}), Candidate("fixed_length", "many", {"base_token_size": 8, "overlap": 0})]
    rows, failed = o.compete(d, o.questions(d), found, lambda *_: None)
    assert [r["cand"] for r in rows] == ["good"] and [f["cand"] for f in failed] == ["bad", "many"]
    assert "no_such_chunker" in failed[0]["error"] and "safety" in failed[1]["error"]
    monkeypatch.setattr("chunkspark.plans.tournament.grid", lambda *_, **__: found[1:])
    with pytest.raises(RuntimeError):
        o.optimize(d)


def test_sampling_rule(spark):
    d = docs(spark, *["x"] * 60)
    size = lambda **p: ChunkOptimizer(Config(mode=p.pop("mode", "light"), proxy=ProxyConfig(**p))).sample(d).count()
    assert size() == 5 and size(mode="full") == 6 and size(above=None) == 60 and size(above=60) == 60
    assert size(above=None, enabled=True, proxy_percent=50, mode="full") == 30


def test_questions_are_cached_by_hash(spark, tmp_path):
    o = ChunkOptimizer(Config(cache_dir=str(tmp_path)))
    d = from_table(docs(spark, BODY, "One. Two."))
    first = {tuple(r) for r in o.questions(d).select("id", "doc_id", "answer_span").collect()}
    again = from_table(docs(spark, BODY, "One. Two.").withColumn("id", F.concat(F.lit("n"), "id")))
    second = o.questions(again).collect()
    assert {r.answer_span for r in second} == {a for *_, a in first} and {r.doc_id for r in second} == {"n0", "n1"}
    assert {r[0] for r in first} == {r.id for r in second}  # from the cache


def test_post_processing(spark):
    c = spark.createDataFrame([("d", 0, "d#0", "One a. Two b."), ("d", 1, "d#1", "one A. two B."), ("d", 2, "d#2", "Three c is here.")], "doc_id string, chunk_index int, chunk_id string, text string")
    assert {(r.a, r.b) for r in D.hybrid_pairs(c, 0.9).collect()} == {("d#0", "d#1")}
    got = post_process(c, Config(post=PostProcessing(dedup=True, overlap=True, overlap_tokens=5))).collect()
    assert sorted(r.text for r in got) == ["One a. Two b. Three c is here.", "Two b. Three c is here."]
    assert post_process(c, Config(post=PostProcessing(dedup=True)), bridge=True).count() == 3
    told = O.enrich(c, spark.createDataFrame([("d", "short")], "doc_id string, summary string")).where("chunk_index = 2").first()
    assert told.text == "[Document Summary: short]\n\nThree c is here."


def test_mixed_queries(spark):
    texts = [f"Some longer sentence number {i} about gardens and rivers." for i in range(60)]
    rows = docs(spark, *texts).select("text", qa.mixed(F.col("text")).alias("m"), qa.mixed(F.col("text")).alias("n"), qa.rewrite(F.col("text"), "keywords").alias("k")).collect()
    assert all(r.m == r.n and r.m in (r.text, r.k) for r in rows) and 40 < sum(r.m == r.k for r in rows) < 60
    other = docs(spark, *texts).select("text", qa.mixed(F.col("text"), "", str.upper).alias("m")).collect()
    assert 25 < sum(r.m == r.text.upper() for r in other) < 55
    assert docs(spark, "x").select(qa.paraphrase(F.col("text"), lambda t: 1 / 0).alias("p")).first().p == "x"


def test_encoders():
    class Service(HttpEncoder):
        def _ask(self, url, body):
            return {"embedding": [float(len(body["prompt"]))]} if url == "one" else {"embeddings": []}

    assert Service("all", "m", 1, single_url="one").embed_batch(["a", "bb"]) == [[1.0], [2.0]] and Service("all", "m", 1).embed_batch(["a"]) == []


def test_adapters(spark):
    plan = Plan("p", "c", {"name": "fixed_length", "params": {"base_token_size": 40, "overlap": 0}})
    made = lambda **k: SimpleNamespace(**k)
    lc = LangChainSplitter(plan, spark).split_documents([made(page_content=BODY, metadata={"source": "s"})])
    li = LlamaIndexParser(plan, spark).get_nodes_from_documents([made(id_="i", text=BODY, metadata={"k": 1})])
    hs = HaystackComponent(plan, spark).run([made(id="h", content=BODY, meta={})])["documents"]
    assert "".join(d.page_content for d in lc) == "".join(d.text for d in li) == "".join(d.content for d in hs) == BODY
    assert lc[0].metadata["doc_id"] == "s" and li[0].metadata["k"] == "1" and hs[0].meta["chunkspark_plan_id"] == "p"
    assert LangChainSplitter(plan, spark).split_documents([]) == []


def test_command_line(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for k in range(3):
        (tmp_path / "docs" / f"{k}.txt").write_text(BODY.replace("Fact", f"Note {k}"))
    plan, report, out = (str(tmp_path / x) for x in ("plan.yaml", "report.json", "chunks.json"))
    main(["optimize", "--docs", str(tmp_path / "docs"), "--candidates", "fixed_length", "sentence_aware", "--out", plan, "--report", report], spark)
    assert len(json.loads(open(report).read())["candidates"]) == 2
    main(["apply", "--plan", plan, "--docs", str(tmp_path / "docs"), "--out", out], spark)
    chunks = json.loads(open(out).read())
    assert {c["doc_id"].rsplit("/", 1)[-1] for c in chunks} == {"0.txt", "1.txt", "2.txt"}
    assert [r.path for r in list_files(spark, str(tmp_path / "docs")).collect()] == ["0.txt", "1.txt", "2.txt"]
    with pytest.raises(SystemExit):
        main(["apply"], spark)
    with pytest.raises(SystemExit):
        main(["apply", "--plan", plan, "--docs", str(tmp_path / "none")], spark)


def test_pdf_readers_and_text_cache(spark, tmp_path):
    root, cache = tmp_path / "docs", str(tmp_path / "cache")
    root.mkdir()
    (root / "a.pdf").write_bytes(b"PDF a")
    (root / "b.txt").write_text("plain b")
    plain = lambda raw: raw.decode().lower()

    def markdown(raw):
        if b"broken" in raw:
            raise ValueError("no")
        return "# " + raw.decode()

    read = lambda **k: {r.path.rsplit("/", 1)[-1]: (r.text, r.raw_text) for r in load_documents(spark, str(root), **k).collect()}
    assert read() == {"b.txt": ("plain b", "plain b")}
    assert read(pdf_reader=markdown)["a.pdf"] == ("# PDF a", "# PDF a")
    assert read(pdf_reader=markdown, pdf_raw_reader=plain)["a.pdf"] == ("# PDF a", "pdf a")
    assert read(pdf_reader=markdown, pdf_raw_reader=plain, high_fidelity=False)["a.pdf"] == ("pdf a", "pdf a")
    (root / "c.pdf").write_bytes(b"broken")
    assert read(pdf_reader=markdown, pdf_raw_reader=plain)["c.pdf"] == ("broken", "broken")
    first = read(pdf_reader=markdown, pdf_raw_reader=plain, cache_dir=cache)
    assert read(pdf_reader=lambda _: "other", cache_dir=cache) == first  # all from the cache
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.bin").write_text("x")
    with pytest.raises(RuntimeError):
        load_documents(spark, str(tmp_path / "empty"))
    assert load_documents(spark, str(tmp_path / "empty"), require=False).count() == 0


def test_streams(spark, tmp_path):
    schema = "id string, text string, at timestamp"
    rows = [("1", "One two. Three four.", "2024-01-01 00:00:00"), ("2", "one  TWO. three four.", "2024-01-01 00:01:00"), ("3", "Other.", "2024-01-01 00:07:00")]
    spark.createDataFrame(rows, "id string, text string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(stream, name, mode="append"):
        stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    source = streaming.stream_table(spark, str(tmp_path / "in"), schema)
    assert sorted(r.text for r in run(streaming.stream_chunks(source, C.proposition), "chunks")) == ["One two.", "Other.", "Three four.", "one  TWO. three four."]
    assert {r.id for r in run(streaming.stream_distinct(source, "at"), "distinct_docs")} in ({"1", "3"}, {"2", "3"})
    assert sorted(r.n for r in run(streaming.windowed_counts(source, "at", "id"), "counts", "complete")) == [1, 1, 1]
    streaming.upsert_index(source.select("id", F.array(F.length("text").cast("double")).alias("vec")), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3


def test_custom_encoder_limits(spark):
    seen = FunctionEncoder(lambda t: [[float(len(x))] for x in t], 1)
    seen.max_chars = 10
    from chunkspark.operators.embed import embed

    assert embed(docs(spark, "x" * 50).withColumnRenamed("id", "chunk_id"), seen).first().vec == [10.0]


def test_a_document_that_fails_does_not_stop_the_rest(spark):
    def rule(text):
        if "bad" in text:
            raise ValueError("no good")
        return [(text, {})]

    made = C._plain(rule, "x", "own")(docs(spark, "fine", "bad", "well")).collect()
    assert sorted((r.doc_id, r.text, r.strategy) for r in made if r.text) == [("0", "fine", "own"), ("2", "well", "own")]
    assert [(r.doc_id, r.chunk_index, r.meta["error"]) for r in made if r.strategy == "error"] == [("1", -1, "ValueError: no good")]


def test_judge(spark):
    rows = [("q1", "who?", "Tom", ["Tom did", "nobody", "Tom too"]), ("q2", "what?", "x", ["no"]), ("q3", "bad", "y", ["z"])]
    data = spark.createDataFrame(rows, "qid string, question string, ground_truth string, contexts array<string>")

    def model(system, user):
        if "Question: bad" in user:
            return "no JSON"
        if user.startswith("Question"):
            return json.dumps({"useful": int("Context: Tom" in user)})
        return 'Sure: {"share": 0.5}'

    got = {r.qid: r for r in judge.judge(data, model).collect()}
    assert got["q1"].context_precision == (1 + 2 / 3) / 2 and got["q2"].context_precision == 0 and got["q1"].context_recall == 0.5
    assert got["q3"].context_recall is None and "ValueError" in got["q3"].error
    assert judge.summary(judge.judge(data, None, 2)).first().n_errors == 2


def test_choice_of_the_judge(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert judge.choose_model(probe=lambda _: False) is None and judge.choose_model(probe=lambda _: True).model == "llama3.2"
    assert judge.choose_model(api_key="k", probe=lambda _: True).model == "gpt-4o-mini" and judge.choose_model("ollama", "m").model == "m"
    with pytest.raises(ValueError):
        judge.choose_model("nothing")


def test_overlap_recommendations(spark):
    c = spark.createDataFrame([("d", k, f"d#{k}", f"Sentence {k} is here", {"a": "b"}) for k in range(3)] + [("e", 0, "e#0", "Alone.", {})], "doc_id string, chunk_index int, chunk_id string, text string, meta map<string,string>")
    got = {r.chunk_id: r.meta for r in O.recommend(c, O.analyse(c, "sentence")).collect()}
    assert got["d#0"] == {"a": "b", "overlap_to_next": "75", "overlap_optimized": "true"} and got["e#0"] == {"overlap_optimized": "true"}
    assert got["d#1"]["overlap_from_prev"] == "75" and set(got["d#2"]) == {"a", "overlap_from_prev", "overlap_optimized"}
    assert {r.doc_id: r.summary for r in O.summaries(docs(spark, "abc", None), lambda t: t[:1]).collect()} == {"0": "a", "1": None}
