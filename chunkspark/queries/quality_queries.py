"""Quality scores, duplicates and overlap over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators import overlap as O
from ..operators import quality as Q
from ..operators.embed import HashingEncoder, embed
from . import query, table
from .eval_queries import HASHED
from .text_queries import COUNT, NORMAL, SENTENCES

W = r"[\pL\pN_]"


def bounded(pattern: str, before: str = rf"(^|[^\pL\pN_])", after: str = rf"($|[^\pL\pN_])") -> str:
    """A pattern between word boundaries that know Unicode, as RE2's don't."""
    return f"{before}({pattern}){after}"


PRON = bounded("this|that|these|those|it|they|he|she|him|her|them")
OUT = [bounded(x) for x in ("above", "below", "previously", "following", "as mentioned", "as discussed", r"see [\pL\pN_]+")]
# "1." and "2." need a word character after them
FIRST = rf"(^|[^\pL\pN_])((firstly|first)($|[^\pL\pN_])|1\.[\pL\pN_])"
SECOND = FIRST.replace("firstly|first", "secondly|second").replace("1", "2")
COMPLETE = f"""begins AS (SELECT doc_id, lower(s) AS s FROM sentences WHERE i = 0),
complete AS (SELECT d.doc_id, greatest(0, 1 - (CASE WHEN regexp_matches(coalesce(b.s, lower(substr(text, 1, 100))), '{PRON}') THEN 0.15::DOUBLE ELSE 0 END
  {" ".join(f"+ CASE WHEN regexp_matches(lower(text), '{p}') THEN 0.1::DOUBLE ELSE 0 END" for p in OUT)}
  + CASE WHEN regexp_matches(lower(text), '{FIRST}') AND NOT regexp_matches(lower(text), '{SECOND}') THEN 0.1::DOUBLE ELSE 0 END)) AS completeness
  FROM documents d LEFT JOIN begins b USING (doc_id))"""
FILL = ", ".join(f"'{w}'" for w in Q.FILLERS)
DENSE = rf"""lengths AS (SELECT doc_id, count(*) AS m, avg(len(regexp_extract_all(s, '\S+'))) AS mean, stddev_pop(len(regexp_extract_all(s, '\S+'))) AS std FROM sentences GROUP BY doc_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
dense AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(0, least(1, 0.4 * (1 - 5 * len(list_filter(w, lambda x: x IN ({FILL})))::DOUBLE / len(w)) + 0.4 * len(list_distinct(w))::DOUBLE / len(w)
  + 0.2 * CASE WHEN m > 1 THEN least(1, 2 * std / (mean + 1)) ELSE 0.5::DOUBLE END)) END AS density FROM dw LEFT JOIN lengths USING (doc_id))"""
EDGES = r"""edges AS (SELECT doc_id, trim(text, E' \n\t\r') AS s FROM documents),
boundary AS (SELECT doc_id, greatest(0, least(1, 1
  - CASE WHEN regexp_matches(s, '(?i)^([a-z.,]|(and|but|or|so|then|however|therefore|thus|hence|this|that|these|those|it|they|he|she)($|[^\pL\pN_]))') THEN 0.15::DOUBLE ELSE 0 END
  - CASE WHEN regexp_matches(s, '([,;:]\s*$)|((^|[^\pL\pN_])(and|or|but|the|a|an)\s*$)|([^.!?"'')\]]\s*$)') THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN s <> '' AND right(s, 1) IN ('.', '!', '?', '"', '''') THEN 0.1::DOUBLE ELSE 0 END)) AS boundary FROM edges)"""
SIZED = f"""sized AS (SELECT doc_id, CASE WHEN r BETWEEN 0.7 AND 1.3 THEN 1.0::DOUBLE WHEN r BETWEEN 0.5 AND 1.5 THEN 0.8::DOUBLE WHEN r BETWEEN 0.3 AND 2.0 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS size
  FROM (SELECT doc_id, {COUNT.format("text")} / 512.0::DOUBLE AS r FROM documents))"""
LEXICAL = r"""bags AS (SELECT doc_id, i, list_distinct(regexp_extract_all(lower(s), '\S+')) AS w FROM sentences),
nexts AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM bags),
lexical AS (SELECT d.doc_id, coalesce(avg(len(list_intersect(w, x))::DOUBLE / (len(w) + len(x) - len(list_intersect(w, x)))), 1) AS coherence FROM documents d LEFT JOIN nexts n ON d.doc_id = n.doc_id AND x IS NOT NULL GROUP BY d.doc_id)"""


def _one(name: str, expr) -> object:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.round(expr(F.col("text")), 6).alias(name))

    f.__name__ = {"completeness": "q_completeness", "density": "q_density", "boundary": "q_boundary", "size": "q_size", "coherence": "q_lexical_coherence"}[name]
    return f


query(f"WITH {SENTENCES}, {COMPLETE} SELECT doc_id, round(completeness, 6) AS completeness FROM complete")(_one("completeness", Q.completeness))
query(f"WITH {SENTENCES}, {DENSE} SELECT doc_id, round(density, 6) AS density FROM dense")(_one("density", Q.density))
query(f"WITH {EDGES} SELECT doc_id, round(boundary, 6) AS boundary FROM boundary")(_one("boundary", Q.boundaries))
query(f"WITH {SIZED} SELECT doc_id, size FROM sized")(_one("size", lambda t: Q.size_score(T.count_tokens(t))))
query(f"WITH {SENTENCES}, {LEXICAL} SELECT doc_id, round(coherence, 6) AS coherence FROM lexical")(_one("coherence", Q.lexical_coherence))

OVERALL = f"""WITH {SENTENCES}, {COMPLETE}, {DENSE}, {EDGES}, {SIZED}, {LEXICAL},
scores AS (SELECT doc_id, completeness, density, boundary, size, coherence, coherence * 0.25 + completeness * 0.2 + density * 0.15 + boundary * 0.2 + size * 0.2 AS overall
  FROM complete JOIN dense USING (doc_id) JOIN boundary USING (doc_id) JOIN sized USING (doc_id) JOIN lexical USING (doc_id))
"""


@query(OVERALL + "SELECT doc_id, round(overall, 6) AS overall, CAST((coherence < 0.6)::INT + (completeness < 0.7)::INT + (density < 0.5)::INT + (boundary < 0.7)::INT + (size < 0.6)::INT AS INTEGER) AS n_issues FROM scores")
def q_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.score(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.round("overall", 6).alias("overall"), F.size("issues").alias("n_issues"))


@query(
    OVERALL
    + "SELECT count(*) AS n, round(avg(overall), 6) AS mean, round(stddev_pop(overall), 6) AS std, round(min(overall), 6) AS least, round(max(overall), 6) AS most, count(*) FILTER (overall < 0.6) AS below, "
    + ", ".join(f"round(avg({k}), 6) AS mean_{k}" for k in Q.WEIGHTS)
    + " FROM scores"
)
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.summarize(Q.score(table(spark, sf_dir, "documents"), "doc_id"))


COHERENT = f"""WITH {SENTENCES},
keyed AS (SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) AS id, s AS text FROM sentences),
{HASHED.format(text="text", source="keyed")},
k AS (SELECT CAST(split_part(id, ':', 1) AS BIGINT) AS doc_id, id, idx, v FROM sparse),
total AS (SELECT doc_id, sum(t * t) AS square FROM (SELECT doc_id, idx, sum(v) AS t FROM k GROUP BY ALL) GROUP BY doc_id),
filled AS (SELECT doc_id, count(DISTINCT id) AS f FROM k GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS m FROM sentences GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(m, 0) <= 1 THEN 1 ELSE round((coalesce(square, 0) - coalesce(f, 0)) / (m * (m - 1)), 6) + 0.0 END AS coherence
FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN total USING (doc_id) LEFT JOIN filled USING (doc_id)"""


@query(COHERENT)
def q_embedding_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.embedding_coherence(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", (F.round("coherence", 6) + 0.0).alias("coherence"))  # no negative zero


@query(f"SELECT sha256({NORMAL.format('text')}) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_groups(table(spark, sf_dir, "documents"), "doc_id")


NGRAMS = r"""ws AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS g FROM ws WHERE len(w) >= 3)"""
PAIRS = """n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, k::DOUBLE / (na.n + nb.n - k) AS similarity FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k::DOUBLE / (na.n + nb.n - k) >= 0.85)"""


@query(f"WITH {NGRAMS}, {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def dedup_ngram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.jaccard_pairs(table(spark, sf_dir, "documents"), D.word_ngrams(F.col("text")), 0.85, "doc_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def dedup_shingle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too slow in SQL: every text shares characters with every other."""
    return D.jaccard_pairs(table(spark, sf_dir, "documents"), D.shingles(F.col("text")), 0.95, "doc_id")


LINKED = f"""WITH RECURSIVE {NGRAMS}, {PAIRS},
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS node FROM both_ways UNION SELECT r.id, b.b FROM reach r JOIN both_ways b ON r.node = b.a),
linked AS (SELECT id, min(node) AS root FROM reach GROUP BY id)
"""


@query(LINKED + "SELECT id, root FROM linked")
def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.jaccard_components(table(spark, sf_dir, "documents"), D.word_ngrams(F.col("text")), 0.85, "doc_id")


@query(
    LINKED
    + """, r AS (SELECT id, row_number() OVER (PARTITION BY root ORDER BY length(text) DESC, id) AS place FROM linked JOIN documents ON id = doc_id)
SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT id FROM r WHERE place > 1)"""
)
def dedup_keep_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return D.survivors(docs.withColumn("seq", F.col("doc_id")), dedup_components(spark, sf_dir), "keep_longest", "seq", "doc_id").select("doc_id", "n_chars")


@query("""SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE similarity >= 0.5""")
def dedup_semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.semantic_pairs(table(spark, sf_dir, "embeddings"), 0.5, "vec_id", "embedding")


@query(r"""WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS s FROM benchmark WHERE length(text) >= 3)
SELECT item_id, CAST(k AS INTEGER) AS seed, (SELECT min(CAST('0x' || substr(md5(CAST(k AS VARCHAR) || ':' || x), 1, 8) AS BIGINT)) FROM (SELECT unnest(s) AS x)) AS least FROM g, (SELECT unnest(range(0, 16)) AS k)""")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where(F.length("text") >= 3).select("item_id", F.posexplode(D.minhash(D.shingles(F.col("text")), 16)).alias("seed", "least"))


@query()
def dedup_minhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.minhash_pairs(table(spark, sf_dir, "benchmark"), 0.8, id_col="item_id")


TURNS = """nb AS (SELECT conv_id AS doc_id, turn AS i, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
n AS (SELECT * FROM nb WHERE b IS NOT NULL)"""
CURRENT = r"""x AS (SELECT doc_id, i, a, b, regexp_extract_all(lower(a), '\S+') AS p, regexp_extract_all(lower(b), '\S+') AS q FROM n),
cur AS (SELECT doc_id, i, a, b, CAST(coalesce(list_max(list_filter(range(1, least(len(p), len(q), 50) + 1), lambda k: p[len(p) - k + 1:] = q[:k])), 0) AS INTEGER) AS current FROM x)"""


@query(f"WITH {TURNS}, {CURRENT} SELECT doc_id, i, current FROM cur")
def overlap_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of conversations."""
    p = O.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return p.select("doc_id", "i", O.current(F.col("a"), F.col("b")).alias("current"))


SENT_FACTOR = r"""CASE WHEN trim(a, E' \n\t\r') = '' THEN 1.0::DOUBLE WHEN right(trim(a, E' \n\t\r'), 1) NOT IN ('.', '!', '?') THEN 1.5::DOUBLE WHEN regexp_matches(trim(b, E' \n\t\r'), '^\p{Ll}') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"""


@query(f"WITH {TURNS} SELECT doc_id, i, {SENT_FACTOR} AS sentence, CAST(greatest(20, least(200, floor(50 * {SENT_FACTOR}))) AS INTEGER) AS optimal FROM n")
def overlap_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.analyse(table(spark, sf_dir, "conversations"), "sentence", doc_col="conv_id", order_col="turn")
    return rows.select("doc_id", "i", "sentence", "optimal")


@query()
def overlap_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.analyse(table(spark, sf_dir, "conversations"), "hybrid", doc_col="conv_id", order_col="turn")


@query()
def overlap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.statistics(overlap_hybrid(spark, sf_dir))


ENHANCED = f"""WITH {SENTENCES.replace("FROM documents", "FROM turns")}""".replace("WITH ", "WITH turns AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), ", 1) + f""",
counted AS (SELECT doc_id, i, s, {COUNT.format("s")} AS n FROM sentences),
sums AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS up, sum(n) OVER (PARTITION BY doc_id ORDER BY i DESC) AS down FROM counted),
heads AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS s FROM sums WHERE up <= 50 GROUP BY doc_id),
tails AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS s FROM sums WHERE down <= 50 GROUP BY doc_id),
o AS (SELECT doc_id, text, lag(doc_id) OVER w AS p, lead(doc_id) OVER w AS q FROM turns WINDOW w AS (PARTITION BY doc_id // 1000 ORDER BY doc_id))
SELECT o.doc_id AS chunk_id, coalesce(t.s || ' ', '') || text || coalesce(' ' || h.s, '') AS text FROM o LEFT JOIN tails t ON t.doc_id = o.p LEFT JOIN heads h ON h.doc_id = o.q"""


@query(ENHANCED)
def overlap_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with sentences of their neighbours; conversations have fewer than 1,000 turns."""
    turns = table(spark, sf_dir, "conversations").withColumn("chunk_id", F.col("conv_id") * 1000 + F.col("turn"))
    return O.add_overlap(turns, 50, "conv_id", "turn").select(F.col("original_id").alias("chunk_id"), "text")


@query(f"""WITH {HASHED.format(text='text', source='(SELECT doc_id AS id, text FROM documents)')},
filled AS (SELECT id, map(list(idx ORDER BY idx), list(v ORDER BY idx)) AS m FROM sparse GROUP BY id)
SELECT doc_id, array_to_string(list_transform(range(0, 256), lambda k: CAST(CAST(round(coalesce(m[CAST(k AS INTEGER)], 0) * 10000) AS INTEGER) AS VARCHAR)), ',') AS vec FROM documents LEFT JOIN filled ON doc_id = id""")
def embedding_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of whole documents in ten-thousandths, joined."""
    e = embed(table(spark, sf_dir, "documents"), HashingEncoder(), "doc_id")
    return e.select("doc_id", F.array_join(F.transform("vec", lambda x: F.round(x * 10000).cast("int").cast("string")), ",").alias("vec"))
