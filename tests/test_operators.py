"""Rules that SQL can't express, on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkspark.functions import text as T
from chunkspark.operators import chunkers as C
from chunkspark.operators import dedup as D
from chunkspark.operators import metrics as M
from chunkspark.operators import overlap as O
from chunkspark.operators import splitters as S
from chunkspark.operators.embed import FunctionEncoder, HashingEncoder, embed, get_encoder
from chunkspark.plans.config import Config
from chunkspark.plans.plan import Plan, plan_id, transform_records
from chunkspark.plans.tournament import ChunkOptimizer, grid
from chunkspark.queries import QUERIES
from chunkspark.sources.cache import TableCache
from chunkspark.sources.documents import from_table, html_text, load_documents, scalable_fingerprint

TEXT = "One two three. Four five six! Is it seven? E.g. this stays. Dr. A. Smith came.\n\nA new paragraph; with parts, and more."


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")


def test_tokens_join_again(spark):
    df = docs(spark, TEXT, "", "  x ", "a\u00a0b 😀").select("text", F.array_join(T.tokens(F.col("text")), "").alias("j"), T.count_tokens(F.col("text")).alias("n"))
    for r in df.collect():
        assert r.text == r.j
        assert r.n == S.count(r.text)


def test_sentences_agree(spark):
    texts = [TEXT, "", "   ", "No end", "U. S. e.g. x. Done. Next", "a?! b. C"]
    for r in docs(spark, *texts).select("text", T.sentences(F.col("text")).alias("s")).collect():
        assert r.s == S.sentences(r.text)


def test_code_blocks(spark):
    t = "a\n```py\nx=1\n```\nb\n```\ny\n``` c"
    r = docs(spark, t).select(T.code_blocks(F.col("text")).alias("b")).first().b
    assert [(x.language, x.content, t[x.start : x.end][:3]) for x in r] == [("py", "x=1\n", "```"), ("text", "y\n", "```")]


def test_fixed_length_covers_text(spark):
    long = " ".join(f"w{i}" for i in range(50))
    got = C.fixed_length(docs(spark, long, ""), 10, 2).orderBy("chunk_index").collect()
    assert len(got) == -(-99 // 8) and got[0].text == "".join(f"w{i} " for i in range(5))


def test_start_index_and_byte_pairs(spark):
    long = " ".join(f"wörd{i}" for i in range(50))
    for r in C.fixed_length(docs(spark, long), 10, 2, add_start_index=True).collect():
        assert long[int(r.meta["start_index"]) :].startswith(r.text)
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    row = docs(spark, long).select(T.tokens(F.col("text"), "tiktoken", path).alias("t"), T.count_tokens(F.col("text"), "auto", path).alias("n"), T.count_tokens(F.lit(None), "tiktoken", path).alias("z")).first()
    assert len(row.t) == row.n and "".join(row.t) == long and row.z == 0
    assert "".join(r.text for r in C.fixed_length(docs(spark, long), 7, 0, tokenizer="tiktoken", vocabulary=path).orderBy("chunk_index").collect()) == long
    with pytest.raises(ValueError):
        T.tokens(F.col("text"), "tiktoken")


def test_recursive_rules():
    assert S.recursive("short text", 10, 0) == [("short text", {"index": 0})]
    out = [p for p, _ in S.recursive("a b c. d e f. g h i. ", 4, 0)]
    assert out == ["a b c.", "d e f.", "g h i."]
    assert all(S.count(p) <= 4 for p, _ in S.recursive("word " * 50, 4, 1))
    assert S.recursive("", 5, 0) == []


def test_sentence_aware_monster():
    long = "x " * 30 + "end."
    out = S.sentence_aware("Hi there. " + long + " Bye now.", 10, 3)
    assert out[0][1]["strategy"] == "sentence_aware" and any(m["strategy"] == "sentence_aware_recursive" for _, m in out)
    assert out[-1][0] == "Bye now."


def test_semantic_and_hybrid_keep_all_sentences():
    text = " ".join(f"Topic {i // 4} sentence {i} here." for i in range(16))
    for rule in (S.semantic, S.hybrid):
        assert " ".join(p for p, _ in rule(text)) == text
        assert rule("") == [] and len(rule("One.")) == 1


def test_parent_child_links():
    nodes = S.parent_child("d", "word " * 100, (50, 10), 0, True)
    by = {n["id"]: n for n in nodes}
    leaf = next(n for n in nodes if n["is_leaf"])
    assert by[leaf["parent_id"]]["level"] == 0 and leaf["id"] in by[leaf["parent_id"]]["child_ids"]


def test_layout():
    md = "# A\nintro\n## B\n|h|\n|-|\n|1|\n|2|\n```py\n# not a header\n```\n# C\nend"
    out = S.layout(md, 5)
    assert out[0][0].startswith("[Section: A]\n# A")
    assert out[-1][1]["lineage"] == "C" and any("# not a header" in p and p.count("```") == 2 for p, _ in out)
    assert sum("|h|" in p for p, _ in out) >= 2


def test_html():
    page = "<html><body><h1>T</h1><!-- c --><p>a <b>b</b></p><script>x</script><ul><li>i</li></ul></body></html>"
    assert [e[0] for e in S.html_elements(page)] == ["T", "a b", "i"]
    assert "x" not in html_text(page) and S.html_section(page)[0][0].startswith("T")


def test_python_ast():
    src = "import os\nX = 1\ndef f():\n    return 1\nclass A:\n    def m(self):\n        pass\n"
    assert [m["node_type"] for _, m in S.python_ast(src)] == ["function", "method"]
    assert S.python_ast("def (")[0][1]["node_type"] == "text" and S.python_ast("X = 1")[0][1]["node_type"] == "module"


def test_json_and_bridges(spark):
    value = {"a": {"b": "x" * 30, "c": "y" * 30}, "d": 1}
    parts = S.json_split(json.dumps(value), 60)
    assert len(parts) >= 2 and S.json_split("no json") == []
    for name in C.list_chunkers():
        got = C.get_chunker(name)(docs(spark, TEXT, "", None)).collect()
        assert name in ("langchain_json",) or got, name
    with pytest.raises(KeyError):
        C.get_chunker("none")


def test_llm_chunkers(spark):
    d = docs(spark, "A one. B two. C three. D four.")
    assert [r.text for r in C.proposition(d, lambda s, u: "1. x\n2) y").collect()] == ["x", "y"]
    assert [r.text for r in C.agentic(d, lambda s, u: "```json\n[1, 3]\n```").orderBy("chunk_index").collect()] == ["A one. B two.", "C three. D four."]
    assert C.contextual_retrieval(d, lambda s, u: "ctx").first().text.startswith("Context: ctx\n\n")


def test_embedding(spark):
    d = docs(spark, "a b a", "", "c").withColumnRenamed("id", "chunk_id")
    got = {r.chunk_id: r.vec for r in embed(d, HashingEncoder()).collect()}
    want = S.hashing_vectors(["a b a", "", "c"])
    assert all(np.allclose(got[str(i)], want[i]) for i in range(3))
    custom = embed(d, FunctionEncoder(lambda t: [[float(len(x))] for x in t], 1)).collect()
    assert {r.chunk_id: r.vec for r in custom} == {"0": [5.0], "1": [0.0], "2": [1.0]}
    with pytest.raises(ValueError):
        get_encoder("nothing")


def test_embedding_reads_whole_texts(spark, tmp_path):
    long = "ab " * 1000 + "end of the text"
    d = docs(spark, long).withColumnRenamed("id", "chunk_id")
    assert np.allclose(embed(d, HashingEncoder()).first().vec, S.hashing_vectors([long])[0])
    assert np.allclose(embed(d, HashingEncoder(), max_chars=1945).first().vec, S.hashing_vectors([long[:1945]])[0])
    spark.createDataFrame([(1, long)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = [int(x) for x in QUERIES["embedding_dense"](spark, str(tmp_path)).first().vec.split(",")]
    assert np.allclose(whole, np.round(S.hashing_vectors([long])[0] * 10000), atol=1)


def test_metrics(spark):
    q = spark.createDataFrame([("q", "d", "query", "alpha beta")], "id string, doc_id string, query string, answer_span string")
    c = spark.createDataFrame([("d#1", "d", "nothing"), ("d#2", "D", "x Alpha  beta y")], "chunk_id string, doc_id string, text string")
    h = spark.createDataFrame([("q", 1, "d#1", 0.5), ("q", 2, "d#2", 0.4)], "qid string, rank int, chunk_id string, sim double")
    r = M.per_question(M.relevance(h, q, c)).first()
    assert r.mrr == 0.5 and r.coverage == 1.0 and r.recall == 1.0 and 0 < r.ndcg < 1


def test_components_and_survivors(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {r.id: r.root for r in D.components(pairs).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    chunks = spark.createDataFrame([("a", "t", 0), ("b", "ttt", 1), ("c", "tt", 2), ("z", "q", 3)], "chunk_id string, text string, seq int")
    kept = D.survivors(chunks, D.components(pairs), "keep_longest")
    assert {r.chunk_id for r in kept.collect()} == {"b", "z"}


def test_jaccard_pairs_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), 12)) for _ in range(40)]
    got = {(r.a, r.b) for r in D.jaccard_pairs(docs(spark, *texts).withColumnRenamed("id", "chunk_id"), D.shingles(F.col("text"), 2), 0.6).collect()}
    sets = [{t[i : i + 2] for i in range(len(t) - 1)} for t in texts]
    want = {tuple(sorted((str(i), str(j)))) for i in range(40) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    assert got == want


def test_overlap(spark):
    rows = [("d", 0, "c0", "One a. Two b."), ("d", 1, "c1", "Three c."), ("e", 0, "c2", "Four d.")]
    c = spark.createDataFrame(rows, "doc_id string, chunk_index int, chunk_id string, text string")
    got = {r.original_id: r.text for r in O.add_overlap(c, 4).collect()}
    assert got == {"c0": "One a. Two b. Three c.", "c1": "Two b. Three c.", "c2": "Four d."}
    r = c.limit(1).select(O.current(F.lit("x Y z"), F.lit("y Z w")).alias("n"), O.current(F.lit(""), F.lit("a")).alias("z")).first()
    assert (r.n, r.z) == (2, 0)


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_bytes(b"hi \xff there")
    (tmp_path / "b.html").write_text("<p>hello</p><script>no</script>")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "d.md").write_text("  ")
    got = {r.ext: r.text for r in load_documents(spark, str(tmp_path)).collect()}
    assert got == {".txt": "hi  there", ".html": "hello"}
    with pytest.raises(FileNotFoundError):
        load_documents(spark, str(tmp_path / "none"))


def test_cache(spark, tmp_path):
    cache, calls = TableCache(spark, str(tmp_path / "cache"), "hash"), []

    def compute(missing):
        calls.append(missing.count())
        return missing.select("hash", F.length("text").alias("n"))

    d = from_table(docs(spark, "a", "bb", "a"))
    for _ in range(2):
        assert cache.get_or_compute(d, compute).count() == 2
    assert calls == [2, 0] and len(scalable_fingerprint(d).first().corpus_hash) == 64


def test_tournament_and_plan(spark, tmp_path):
    body = " ".join(f"Fact {i} is about item{i} and thing{i}." for i in range(40))
    d = from_table(docs(spark, body, body.replace("Fact", "Note")))
    seen = []
    result = ChunkOptimizer(Config()).optimize(d, candidate_names=["fixed_length", "sentence_aware"], sweep={"sizes": [64], "ratios": [0.125]}, on_result=seen.append)
    assert len(seen) == 2 and result.report[0]["score"] >= result.report[1]["score"]
    path = str(tmp_path / "plan.yaml")
    result.plan.write(path)
    plan = Plan.read(path)
    assert plan == result.plan and plan.id == plan_id(plan.corpus_hash, plan.generator_pipeline["name"], plan.generator_pipeline["params"])
    assert plan.apply(d).count() == plan.to_transformer().transform(d).count() > 0
    assert transform_records(plan, [{"page_content": body, "metadata": {"k": 1}}], spark)[0]["metadata"]["chunkspark_plan_id"] == plan.id


def test_grid():
    assert [c.name for c in grid(set(), ["nothing"])] == ["fixed_length", "recursive_character", "sentence_aware"]
    swept = grid({".html"}, ["fixed_length", "parent_child"], [256, 512], [0.1, 0.2])
    assert len(swept) == 5 and swept[0].label == "fixed_length (256|10%)"
