"""All queries of the engine and, where SQL can state them, their SQL.

Each query takes (spark, sf_dir) and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import SUMMARY_BUDGETS, PipelineConfig
from docloom.functions import text as TX
from docloom.functions.vectors import HashEmbedding, embedder, with_embedding
from docloom.operators import dedup, evaluate, graph, phrases, salience, segments
from docloom.operators.blocks import nearest, similar_pairs
from docloom.operators.components import connected_components
from docloom.plans import pipeline, prompts, trace
from docloom.runtime import one_row_per, spread, table, written

FLAGSHIP = "e2e_summary"
# the setting of the reported runs: sentence-packed chunks of 150 to 1,500 tokens
REPORTED = PipelineConfig(
    alpha=0.10, beta=0.30, entity_merge_threshold=0.80, target_min_tokens=150, target_max_tokens=1500, semantic_percentile=50.0, semantic_min_chunk=75, dedup_threshold=0.85
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ SQL parts

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_NORM = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'),
    '^{_WS}+', ''), '{_WS}+$', '')"""


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


_PARAGRAPHS = f"""
norm AS (SELECT doc_id, {_NORM} AS t FROM documents WHERE text IS NOT NULL),
para AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(t, '\\n{_WS}*\\n+', chr(1), 'g'), chr(1)),
    lambda p: {_strip('p')}), lambda p: p <> '')) AS p, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(t,
    '\\n{_WS}*\\n+', chr(1), 'g'), chr(1)), lambda p: {_strip('p')}), lambda p: p <> ''), 1) - 1 AS paragraph_idx FROM norm)"""


def _split(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?。！？]){_WS}+', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, '([.!?。！？])([A-Z\\x{{c0}}-\\x{{1ef4}}])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


_SENTENCES = f"""{_PARAGRAPHS},
sent0 AS (SELECT doc_id, paragraph_idx, unnest({_split('p')}) AS s, generate_subscripts({_split('p')}, 1) AS i FROM para),
sent AS (SELECT doc_id, paragraph_idx, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_idx, i) - 1 AS sent_index, s AS text FROM sent0)"""


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+'))"


_UNITS = f"""{_SENTENCES},
unit AS (SELECT doc_id, sent_index AS center, count(*) OVER w AS sentence_count, string_agg(text, ' ') OVER w AS text FROM sent
    WINDOW w AS (PARTITION BY doc_id ORDER BY sent_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


# ---------------------------------------------------------- text and segments


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, {_NORM} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", TX.normalize_text(F.col("text")).alias("normalized"))


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, paragraph_idx, p AS text FROM para")
def split_paragraphs(spark, sf_dir):
    rows = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(TX.split_paragraphs(TX.normalize_text(F.col("text")))).alias("paragraph_idx", "text"))
    return rows.withColumn("paragraph_idx", F.col("paragraph_idx").cast("long"))


@query(f"WITH {_SENTENCES} SELECT doc_id, paragraph_idx, sent_index, text FROM sent")
def split_sentences(spark, sf_dir):
    out = segments.sentence_table(_docs(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", F.col("paragraph_idx").cast("long"), F.col("sent_index").cast("long"), "text")


@query(f"WITH {_UNITS} SELECT doc_id, center, sentence_count, {_tokens('text')} AS tokens, text FROM unit")
def tri_segments(spark, sf_dir):
    out = segments.segment_table(_docs(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", F.col("center").cast("long"), F.col("sentence_count").cast("long"), F.col("tokens").cast("long"), "text")


@query(f"SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE {_tokens('text')} END AS tokens FROM documents")
def token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", TX.count_tokens(F.col("text")).cast("long").alias("tokens"))


_FLAT = _strip(f"regexp_replace(text, '{_WS}+', ' ', 'g')")


@query(f"""WITH flat AS (SELECT doc_id, {_FLAT} AS t FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, t, unnest(list_filter(string_split(regexp_replace(t, '([.!?。！？]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS s,
  generate_subscripts(list_filter(string_split(regexp_replace(t, '([.!?。！？]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), 1) AS i FROM flat),
sized AS (SELECT *, sum({_tokens('s')}) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM parts),
kept AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS k FROM sized WHERE total <= 80 GROUP BY doc_id)
SELECT f.doc_id, coalesce(k, array_to_string((string_split(t, ' '))[1:80], ' ')) AS trimmed FROM flat f LEFT JOIN kept USING (doc_id)""")
def trim_to_budget(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", TX.trim_to_words(F.col("text"), F.lit(80)).alias("trimmed"))


@query("""SELECT d.sample_id, d.doc_ord, '[Document ' || (d.doc_ord + 1) || ': ' || d.document_id || ']' ||
  CASE WHEN coalesce(title, '') <> '' THEN E'\\nTitle: ' || title ELSE '' END || CASE WHEN coalesce(source, '') <> '' THEN E'\\nSource: ' || source ELSE '' END
  || coalesce(E'\\n' || text, '') AS block FROM documents d""")
def document_blocks(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("sample_id", "doc_ord", TX.document_block(F.col("doc_ord") + 1, F.col("document_id"), F.col("title"), F.col("source"), F.col("text")).alias("block"))


@query("""SELECT call_id, CASE WHEN count(*) > 1 THEN max(text) ELSE max(text) END AS text FROM llm_results WHERE call_id IS NOT NULL GROUP BY call_id""")
def distinct_answers(spark, sf_dir):
    """Deliveries that were repeated count once."""
    return table(spark, sf_dir, "llm_results").where("call_id is not null").groupBy("call_id").agg(F.max("text").alias("text"))


# ------------------------------------------------------------------- chunking


@query(f"""WITH RECURSIVE {_UNITS},
sized AS (SELECT doc_id, center, {_tokens('text')} AS n, text FROM unit),
pack AS (SELECT doc_id, center, n AS cur, 0 AS position FROM sized WHERE center = 0
  UNION ALL SELECT s.doc_id, s.center, CASE WHEN p.cur >= 150 OR p.cur + s.n > 1500 THEN s.n ELSE p.cur + s.n END,
    CASE WHEN p.cur >= 150 OR p.cur + s.n > 1500 THEN p.position + 1 ELSE p.position END
  FROM pack p JOIN sized s ON s.doc_id = p.doc_id AND s.center = p.center + 1)
SELECT p.doc_id, CAST(p.position AS BIGINT) AS position, count(*) AS segments, string_agg(s.text, E'\\n' ORDER BY s.center) AS text
FROM pack p JOIN sized s ON s.doc_id = p.doc_id AND s.center = p.center GROUP BY p.doc_id, p.position""")
def chunk_simple(spark, sf_dir):
    out = segments.simple_chunks(_docs(spark, sf_dir), ["doc_id"], 150, 1500)
    return out.select("doc_id", F.col("position").cast("long"), F.size("units").cast("long").alias("segments"), "text")


@query()
def chunk_semantic(spark, sf_dir):
    out = segments.semantic_chunks(_docs(spark, sf_dir), ["doc_id"], 150, 1500, 50.0, 75)
    return out.select("doc_id", "position", F.size("units").alias("segments"), "text")


@query(f"""SELECT s.doc_id, s.sentence_no, c.chunk_no FROM (SELECT DISTINCT doc_id, sentence_no, text FROM sentences WHERE text IS NOT NULL) s
JOIN (SELECT DISTINCT doc_id, chunk_no, text FROM chunks WHERE text IS NOT NULL) c ON s.doc_id = c.doc_id
AND contains({_strip(f"regexp_replace(c.text, '{_WS}+', ' ', 'g')")}, {_strip(f"regexp_replace(s.text, '{_WS}+', ' ', 'g')")})""")
def sentences_in_chunks(spark, sf_dir):
    """Which stored sentences stand in which chunk of their document, whatever the white space."""
    s = table(spark, sf_dir, "sentences").where("text is not null").select("doc_id", "sentence_no", TX.collapse(F.col("text")).alias("s")).distinct()
    c = table(spark, sf_dir, "chunks").where("text is not null").select("doc_id", "chunk_no", TX.collapse(F.col("text")).alias("c")).distinct()
    return s.join(c, "doc_id").where(F.col("c").contains(F.col("s"))).select("doc_id", "sentence_no", "chunk_no")


# ----------------------------------------------------------- vectors and graph


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("int").alias("label"), "vec_id", "embedding")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""SELECT a.label, a.vec_id AS i, b.vec_id AS j, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE {_COS} >= 0.3""")
def duplicate_pairs(spark, sf_dir):
    return similar_pairs(_vectors(spark, sf_dir), ["label"], "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE v AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
near AS (SELECT a.label, b.vec_id, list(a.vec_id) AS earlier FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.3 GROUP BY a.label, b.vec_id),
walk AS (SELECT label, rn, vec_id, [vec_id] AS leaders, vec_id AS leader FROM v WHERE rn = 1
  UNION ALL SELECT v.label, v.rn, v.vec_id,
    CASE WHEN len(list_intersect(w.leaders, coalesce(n.earlier, []))) > 0 THEN w.leaders ELSE list_append(w.leaders, v.vec_id) END,
    coalesce(list_min(list_intersect(w.leaders, coalesce(n.earlier, []))), v.vec_id)
  FROM walk w JOIN v ON v.label = w.label AND v.rn = w.rn + 1 LEFT JOIN near n ON n.label = v.label AND n.vec_id = v.vec_id),
sized AS (SELECT label, vec_id, leader, count(*) OVER (PARTITION BY label, leader) AS n FROM walk)
SELECT label, vec_id, leader AS representative, vec_id = leader AS is_representative FROM sized WHERE n > 1""")
def duplicate_groups(spark, sf_dir):
    out = dedup.duplicate_groups(_vectors(spark, sf_dir), "label", "vec_id", [], "embedding", 0.3)
    return out.select("label", "vec_id", "representative", "is_representative")


@query(f"""SELECT label, i, j, similarity FROM (SELECT a.label, a.vec_id AS i, b.vec_id AS j, round({_COS}, 6) AS similarity,
  row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rk FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rk <= 8""")
def knn_edges(spark, sf_dir):
    return nearest(_vectors(spark, sf_dir), ["label"], "vec_id", "embedding", 8).withColumn("similarity", F.round("similarity", 6))


_EDGES = f"""cand AS (SELECT DISTINCT label, least(i, j) AS i, greatest(i, j) AS j FROM (SELECT a.label, a.vec_id AS i, b.vec_id AS j,
  row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rk FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rk <= 8
  UNION SELECT a.label, a.vec_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 20 = b.vec_id // 20 AND a.vec_id % 20 + 1 = b.vec_id % 20),
part AS (SELECT c.label, c.i, c.j, CASE WHEN c.i // 20 = c.j // 20 THEN exp(-abs(c.i % 20 - c.j % 20) / 3.0) ELSE 0.0 END AS p,
  greatest({_COS}, 0.0) AS c FROM cand c JOIN embeddings a ON a.label = c.label AND a.vec_id = c.i JOIN embeddings b ON b.label = c.label AND b.vec_id = c.j)"""


def _edge_parts(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("document", F.floor(F.col("vec_id") / 20)).withColumn("position", F.col("vec_id") % 20)
    c = graph.candidate_edges(v, "label", "vec_id", "document", "position", "embedding", 8)
    return graph.edge_components(c, v, "label", "vec_id", "document", "position", "embedding", None, None)


@query(f"""WITH {_EDGES} SELECT label, i, j, round(p, 6) AS position_similarity, round(c, 6) AS content_similarity, round(0.1 * p + 0.6 * c, 6) AS weight FROM part WHERE 0.1 * p + 0.6 * c > 0""")
def weighted_edges(spark, sf_dir):
    out = graph.weigh(_edge_parts(spark, sf_dir), REPORTED.weights(), 0.35)
    return out.select("label", "i", "j", *[F.round(c, 6).alias(c) for c in ("position_similarity", "content_similarity", "weight")])


_FULL_EDGES = ORACLES["duplicate_groups"].split("SELECT label, vec_id, leader AS representative")[0].rstrip() + f""", {_EDGES},
ph AS (SELECT label, vec_id, 'p' || vec_id % 7 AS phrase, 1.15 AS t FROM embeddings UNION ALL SELECT label, vec_id, 'q' || vec_id % 11, 1.0 FROM embeddings),
df AS (SELECT label, phrase, count(*) AS df FROM ph GROUP BY ALL), size AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
w AS (SELECT label, vec_id, phrase, t * (ln((size.n + 1.0) / (df + 1)) + 1) AS w FROM ph JOIN df USING (label, phrase) JOIN size USING (label)),
norm AS (SELECT label, vec_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dot AS (SELECT part.label, part.i, part.j, sum(a.w * b.w) AS dot FROM part JOIN w a ON a.label = part.label AND a.vec_id = part.i JOIN w b ON b.label = part.label AND b.vec_id = part.j AND b.phrase = a.phrase GROUP BY ALL),
full_part AS (SELECT part.label, part.i, part.j, p, c, coalesce(dot / (x.norm * y.norm), 0) AS e, CASE WHEN g.n > 1 AND g.leader = h.leader THEN CAST(0.35 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS penalty
  FROM part JOIN norm x ON x.label = part.label AND x.vec_id = part.i JOIN norm y ON y.label = part.label AND y.vec_id = part.j
  JOIN sized g ON g.label = part.label AND g.vec_id = part.i JOIN sized h ON h.label = part.label AND h.vec_id = part.j
  LEFT JOIN dot ON dot.label = part.label AND dot.i = part.i AND dot.j = part.j)
SELECT label, i, j, round(e, 6) AS entity_similarity, penalty AS redundancy_penalty, penalty < 1 AS is_duplicate_edge, round((0.1 * p + 0.3 * e + 0.6 * c) * penalty, 6) AS weight
FROM full_part WHERE (0.1 * p + 0.3 * e + 0.6 * c) * penalty > 0"""


@query(_FULL_EDGES)
def full_edges(spark, sf_dir):
    """Edges with phrases (made from the numbers of the vectors) and duplicate groups."""
    v = _vectors(spark, sf_dir).withColumn("document", F.floor(F.col("vec_id") / 20)).withColumn("position", F.col("vec_id") % 20)
    c = graph.candidate_edges(v, "label", "vec_id", "document", "position", "embedding", 8)
    parts = [v.select("label", "vec_id", F.concat(F.lit(name), (F.col("vec_id") % n).cast("string")).alias("phrase"), F.array(F.lit(kind)).alias("types")) for name, n, kind in (("p", 7, "org"), ("q", 11, "entity"))]
    typed = parts[0].unionByName(parts[1])
    similarity = phrases.phrase_similarity(typed, phrases.phrase_idf(typed, v, "label", "vec_id"), c, "label", "vec_id")
    groups = dedup.duplicate_groups(v, "label", "vec_id", [], "embedding", 0.3)
    out = graph.weigh(graph.edge_components(c, v, "label", "vec_id", "document", "position", "embedding", similarity, groups), REPORTED.weights(), 0.35)
    return out.select("label", "i", "j", F.round("entity_similarity", 6).alias("entity_similarity"), "redundancy_penalty", "is_duplicate_edge", F.round("weight", 6).alias("weight"))


_GRID = """grid AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS grid_no, a AS alpha, b AS beta, round(1 - a - b, 10) AS gamma FROM (
  SELECT DISTINCT round(i * 0.05, 10) AS a, round(least(j * 0.1, 1 - i * 0.05), 10) AS b FROM generate_series(0, 4) x(i), generate_series(0, 10) y(j)))"""


@query(f"WITH {_GRID} SELECT CAST(grid_no AS INTEGER) AS grid_no, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, CAST(abs(gamma) AS DOUBLE) AS gamma FROM grid")
def weight_grid(spark, sf_dir):
    return graph.grid_table(spark)


@query(f"""WITH {_EDGES}, {_GRID} SELECT CAST(grid_no AS INTEGER) AS grid_no, count(*) AS edges, round(sum(alpha * p + gamma * c), 4) AS total FROM part, grid WHERE alpha * p + gamma * c > 0 GROUP BY grid_no""")
def grid_edge_weights(spark, sf_dir):
    out = graph.weigh_grid(_edge_parts(spark, sf_dir))
    return out.groupBy("grid_no").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 4).alias("total"))


@query(f"""WITH RECURSIVE e AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_COS} >= 0.3),
r AS (SELECT label, i AS node, i AS seen FROM e UNION SELECT r.label, r.node, e.j FROM r JOIN e ON e.label = r.label AND e.i = r.seen)
SELECT label, node, min(seen) AS component FROM r GROUP BY label, node""")
def components(spark, sf_dir):
    return connected_components(similar_pairs(_vectors(spark, sf_dir), ["label"], "vec_id", "embedding", 0.3), ["label"])


@query()
def leiden_communities(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    edges = graph.weigh(_edge_parts(spark, sf_dir), REPORTED.weights(), 0.35)
    return graph.communities(v, edges, "label", "vec_id")


_CENTER = "center AS (SELECT label, embedding AS c FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))"


@query(f"""WITH {_CENTER} SELECT label, vec_id, score FROM (SELECT e.label, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(c AS DOUBLE[])), 6) AS score,
  row_number() OVER (PARTITION BY e.label ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(c AS DOUBLE[])) DESC, vec_id) AS rk FROM embeddings e JOIN center USING (label)) WHERE rk <= 10""")
def centroid_topk(spark, sf_dir):
    from pyspark.sql import Window as W

    v = _vectors(spark, sf_dir)
    centers = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    scored = salience.centroid_scores(v, centers, ["label"])
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.round("score", 12).desc(), "vec_id"))
    return scored.withColumn("rk", rank).where("rk <= 10").select("label", "vec_id", F.round("score", 6).alias("score"))


def _pacsum_sql(stride: int, beta: float, lam1: float) -> str:
    keep = "" if stride == 1 else f"WHERE (rn - 1) % {stride} = 1"
    return f"""WITH v AS (SELECT label, vec_id, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) {keep}),
s AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, {_COS} AS x FROM v a JOIN v b ON a.label = b.label),
t AS (SELECT label, min(x) + {beta} * (max(x) - min(x)) AS t FROM s GROUP BY label),
e AS (SELECT s.label, i, j, greatest(x - t, 0) AS w FROM s JOIN t USING (label) WHERE i < j),
f AS (SELECT label, i AS vec_id, w AS score FROM e UNION ALL SELECT label, j, -{lam1} * w FROM e UNION ALL SELECT label, vec_id, 0 FROM v)
SELECT label, vec_id, round(sum(score), 4) + 0 AS score FROM f GROUP BY label, vec_id"""


@query(_pacsum_sql(1, 0.0, 0.0))
def pacsum_e2a(spark, sf_dir):
    out = salience.centrality_scores(_vectors(spark, sf_dir), ["label"], "vec_id")
    return out.select("label", "vec_id", (F.round("score", 4) + 0).alias("score"))


@query(_pacsum_sql(2, 0.3, 0.5))
def pacsum_e2b(spark, sf_dir):
    out = salience.centrality_scores(_vectors(spark, sf_dir), ["label"], "vec_id", stride=2, beta=0.3, lambda1=0.5)
    return out.select("label", "vec_id", (F.round("score", 4) + 0).alias("score"))


@query(f"""WITH RECURSIVE {_SENTENCES}, item AS (SELECT doc_id, sent_index, {_tokens('text')} AS n,
  row_number() OVER (PARTITION BY doc_id ORDER BY {_tokens('text')} % 7, sent_index) AS rk FROM sent),
pick AS (SELECT doc_id, sent_index, rk, true AS taken, n AS total FROM item WHERE rk = 1
  UNION ALL SELECT i.doc_id, i.sent_index, i.rk, p.total < 60 AND p.total + i.n <= 60, p.total + CASE WHEN p.total < 60 AND p.total + i.n <= 60 THEN i.n ELSE 0 END
  FROM pick p JOIN item i ON i.doc_id = p.doc_id AND i.rk = p.rk + 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS rank, sent_index FROM pick WHERE taken""")
def budget_select(spark, sf_dir):
    """Sentences by a score (length modulo 7, falling) under a budget of 60 tokens."""
    s = segments.sentence_table(_docs(spark, sf_dir), ["doc_id"]).withColumn("tokens", TX.count_tokens(F.col("text")))
    out = salience.select_by_budget(s.withColumn("score", (-(F.col("tokens") % 7)).cast("double")), ["doc_id"], "sent_index", 60)
    return out.select("doc_id", F.col("rank").cast("long"), F.col("sent_index").cast("long"))


@query(f"""WITH {_SENTENCES}, first AS (SELECT d.sample_id, s.text, min(struct_pack(a := d.doc_ord, b := s.sent_index)) AS place FROM sent s JOIN documents d USING (doc_id) WHERE d.sample_id IS NOT NULL GROUP BY d.sample_id, s.text),
run AS (SELECT *, row_number() OVER w AS rk, sum({_tokens('text')}) OVER w AS total FROM first WINDOW w AS (PARTITION BY sample_id ORDER BY place, text))
SELECT sample_id, string_agg(text, ' ' ORDER BY rk) AS support FROM run WHERE rk = 1 OR total <= 400 GROUP BY sample_id""")
def compact_support(spark, sf_dir):
    s = segments.sentence_table(_docs(spark, sf_dir).where("sample_id is not null"), ["sample_id", "doc_ord"])
    return salience.compact_support(s, ["sample_id"], ["doc_ord", "sent_index"], "text", 400)


@query()
def hash_embedding(spark, sf_dir):
    d = _docs(spark, sf_dir).where("text is not null").select("doc_id", "text")
    return with_embedding(d, "text", embedder("hash")).select("doc_id", "embedding")


# -------------------------------------------------------------------- phrases

# SQL's regular expressions know word bounds and word characters in ASCII only.  So every run of word characters is put
# between two marks first, and a bound is written as the mark.
_W = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
_SP = r"[\t-\r \x{85}\p{Z}]"
_MARKED = f"regexp_replace(text, '([{_W}]+)', chr(1) || '\\1' || chr(2), 'g')"
_UNMARK = r"regexp_replace({}, '[\x01\x02]', '', 'g')"
_NUM = r"\p{Nd}+(?:[,.]\p{Nd}+)?"
_MONEY = rf"(?i)(?:\$|USD|VND|đồng|tỷ|triệu){_SP}?{_NUM}(?:{_SP}?(?:billion|million|trillion|tỷ|triệu))?|{_NUM}{_SP}?(?:billion|million|trillion|tỷ|triệu){_SP}?(?:đồng|USD|VND)?"
_FACT_SQL = rf"""unnest(list_concat(
  list_transform(regexp_extract_all(m, '\x01\p{{Nd}}+\x02(?:[,.]\x01\p{{Nd}}+\x02)?{_SP}?%'), lambda x: {{'k': 'percent', 'p': x}}),
  list_transform(regexp_extract_all(text, '{_MONEY}'), lambda x: {{'k': 'money', 'p': x}}),
  list_transform(regexp_extract_all(m, '\x01\p{{Nd}}{{1,2}}\x02[/-]\x01\p{{Nd}}{{1,2}}(?:\x02[/-]\x01\p{{Nd}}{{2,4}})?\x02|\x01\p{{Nd}}{{4}}\x02'), lambda x: {{'k': 'date', 'p': x}})))"""


@query(f"""SELECT doc_id, x.k AS phrase_type, {_UNMARK.format("x.p")} AS phrase, count(*) AS n
FROM (SELECT doc_id, {_FACT_SQL} AS x FROM (SELECT doc_id, text, {_MARKED} AS m FROM documents WHERE text IS NOT NULL)) GROUP BY ALL""")
def factual_phrases(spark, sf_dir):
    """Percentages, amounts and dates of all texts, as they stand."""
    found = phrases.factual_phrases(_docs(spark, sf_dir).where("text is not null"), ["doc_id"])
    return found.groupBy("doc_id", "phrase_type", "phrase").agg(F.count("*").alias("n"))


_CAP = rf"[A-Z\x{{c0}}-\x{{1ef4}}](?:[\x01\x02]*[{_W}\x{{c0}}-\x{{1ef9}}.\-])+[\x01\x02]*(?:{_SP}+|$)"
_CAPS = rf"""caps AS (SELECT doc_id, unnest(regexp_extract_all(m, '[\x01\x02]{_CAP}(?:\x01?{_CAP}){{0,4}}')) AS raw
  FROM (SELECT doc_id, {_MARKED} AS m FROM documents WHERE text IS NOT NULL)),
named AS (SELECT doc_id, lower({_strip(f"regexp_replace({_UNMARK.format('raw')}, '{_WS}+', ' ', 'g')")}) AS phrase FROM caps)"""


@query(f"WITH {_CAPS} SELECT doc_id, phrase, count(*) AS n FROM named WHERE phrase <> '' GROUP BY doc_id, phrase")
def capitalised_phrases(spark, sf_dir):
    """The generic recogniser on all texts."""
    d = _docs(spark, sf_dir).where("text is not null")
    out = phrases.capitalised_phrases(d, ["doc_id"]).withColumn("phrase", TX.normalize_phrase(F.col("phrase"))).where("phrase <> ''")
    return out.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def _part_phrases(spark, sf_dir):
    """Orders as samples' chunks, part brands and types as phrases."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey)
    one = rows.select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("chunk"), F.lower("p_brand").alias("phrase"), F.lit("org").alias("phrase_type"))
    two = rows.select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("chunk"), F.lower("p_type").alias("phrase"), F.lit("entity").alias("phrase_type"))
    return phrases.phrase_map(one.unionByName(two), ["sample", "chunk"])


_PARTS = """raw AS (SELECT l_suppkey AS sample, l_orderkey AS chunk, lower(p_brand) AS phrase, 'org' AS kind FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT l_suppkey, l_orderkey, lower(p_type), 'entity' FROM lineitem JOIN part ON l_partkey = p_partkey),
map AS (SELECT sample, chunk, phrase, list_sort(list(DISTINCT kind)) AS types FROM raw GROUP BY sample, chunk, phrase),
size AS (SELECT sample, count(DISTINCT chunk) AS n FROM map GROUP BY sample),
idf AS (SELECT sample, phrase, count(DISTINCT chunk) AS frequency, ln((any_value(n) + 1) / (count(DISTINCT chunk) + 1)) + 1 AS idf FROM map JOIN size USING (sample) GROUP BY sample, phrase)"""


@query(f"WITH {_PARTS} SELECT sample, chunk, phrase, array_to_string(types, ',') AS types FROM map")
def phrase_map(spark, sf_dir):
    return _part_phrases(spark, sf_dir).withColumn("types", F.array_join("types", ","))


@query(f"WITH {_PARTS} SELECT sample, phrase, frequency, round(idf, 6) AS idf FROM idf")
def phrase_idf(spark, sf_dir):
    m = _part_phrases(spark, sf_dir)
    return phrases.phrase_idf(m, m, "sample", "chunk").withColumn("idf", F.round("idf", 6))


@query(f"""WITH {_PARTS}, w AS (SELECT m.sample, chunk, phrase, idf * CASE WHEN list_contains(types, 'org') THEN 1.15 ELSE 1.0 END AS w FROM map m JOIN idf USING (sample, phrase)),
norm AS (SELECT sample, chunk, sqrt(sum(w * w)) AS n FROM w GROUP BY sample, chunk),
d AS (SELECT a.sample, a.chunk AS i, b.chunk AS j, sum(a.w * b.w) AS d FROM w a JOIN w b ON a.sample = b.sample AND a.phrase = b.phrase AND b.chunk = a.chunk + 1 GROUP BY a.sample, a.chunk, b.chunk)
SELECT x.sample, x.chunk AS i, y.chunk AS j, round(coalesce(d.d / (x.n * y.n), 0), 6) AS similarity FROM norm x JOIN norm y ON x.sample = y.sample AND y.chunk = x.chunk + 1
LEFT JOIN d ON d.sample = x.sample AND d.i = x.chunk AND d.j = y.chunk""")
def phrase_similarity(spark, sf_dir):
    m = written(_part_phrases(spark, sf_dir), "phrase-map")
    chunks = m.select("sample", "chunk").distinct()
    pairs = chunks.select("sample", F.col("chunk").alias("i"), (F.col("chunk") + 1).alias("j")).join(chunks.select("sample", F.col("chunk").alias("j")), ["sample", "j"])
    out = phrases.phrase_similarity(m, phrases.phrase_idf(m, m, "sample", "chunk"), pairs.select("sample", "i", "j"), "sample", "chunk")
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_PARTS}, merged AS (SELECT sample, phrase, list_sort(list(DISTINCT t)) AS types FROM (SELECT sample, phrase, unnest(types) AS t FROM map) GROUP BY sample, phrase),
r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY types, phrase) AS rk, count(*) OVER (PARTITION BY sample) AS n FROM merged)
SELECT sample, string_agg('- ' || phrase || ' (' || array_to_string(types, ', ') || ')', E'\\n' ORDER BY rk) FILTER (WHERE rk <= 120) ||
  CASE WHEN max(n) > 120 THEN E'\\n- ... ' || (max(n) - 120) || ' additional anchors omitted' ELSE '' END AS entities FROM r GROUP BY sample""")
def entity_list(spark, sf_dir):
    return phrases.entity_list(_part_phrases(spark, sf_dir), ["sample"])


@query()
def canonical_phrases(spark, sf_dir):
    d = _docs(spark, sf_dir).where("text is not null and sample_id is not null")
    mapped = phrases.phrase_map(phrases.extract(d.select("sample_id", "doc_id", "text"), ["sample_id", "doc_id"]), ["sample_id", "doc_id"])
    return phrases.canonicalise(mapped, "sample_id", ["doc_id"], 0.80, HashEmbedding())


# ----------------------------------------------------------------- evaluation


def _scored(spark, sf_dir):
    """Stored summaries, and the references of their samples."""
    runs = one_row_per(table(spark, sf_dir, "results").select("result_id", "sample_id", F.col("generated_summary").alias("prediction")), "result_id")
    refs = table(spark, sf_dir, "ref_texts").where(F.col("text").rlike(r"(?U)\S")).select("sample_id", "ref_idx", F.col("text").alias("reference"))
    return runs, refs


_PAIRS = f"""runs AS (SELECT result_id, min(struct_pack(s := sample_id, p := generated_summary)) AS r FROM results WHERE result_id IS NOT NULL GROUP BY result_id),
pairs AS (SELECT result_id, ref_idx, coalesce(r.p, '') AS p, text AS q FROM runs JOIN ref_texts t ON t.sample_id = r.s WHERE regexp_matches(text, '[^\\s\\p{{Z}}]'))"""


def _rouge_sql(n: int, words: str) -> str:
    grams = "t" if n == 1 else "list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])"
    return f"""WITH {_PAIRS}, tok AS (SELECT result_id, ref_idx, {words.format(x='p')} AS p, {words.format(x='q')} AS q FROM pairs),
g AS (SELECT result_id, ref_idx, {grams.replace('t', 'p') if n == 1 else grams.replace('len(t)', 'len(p)').replace('t[i]', 'p[i]').replace('t[i + 1]', 'p[i + 1]')} AS p,
  {grams.replace('t', 'q') if n == 1 else grams.replace('len(t)', 'len(q)').replace('t[i]', 'q[i]').replace('t[i + 1]', 'q[i + 1]')} AS q FROM tok),
a AS (SELECT result_id, ref_idx, x, count(*) AS n FROM (SELECT result_id, ref_idx, unnest(p) AS x FROM g) GROUP BY ALL),
b AS (SELECT result_id, ref_idx, x, count(*) AS n FROM (SELECT result_id, ref_idx, unnest(q) AS x FROM g) GROUP BY ALL),
c AS (SELECT result_id, ref_idx, sum(least(a.n, b.n)) AS common FROM a JOIN b USING (result_id, ref_idx, x) GROUP BY ALL)
SELECT g.result_id, g.ref_idx, round(coalesce(2.0 * common / (len(g.p) + len(g.q)), 0), 6) AS score FROM g LEFT JOIN c USING (result_id, ref_idx)"""


_WORDS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
_CHARS = "list_filter(string_split(regexp_replace(lower({x}), '" + _WS.replace("{", "{{").replace("}", "}}") + "+', '', 'g'), ''), lambda c: c <> '')"


@query(_rouge_sql(1, _WORDS))
def rouge1_words(spark, sf_dir):
    runs, refs = _scored(spark, sf_dir)
    return evaluate.ngram_scores(runs, refs, "sample_id", ["result_id"], ["ref_idx"], 1, "default").withColumn("score", F.round("score", 6))


@query(_rouge_sql(2, _WORDS))
def rouge2_words(spark, sf_dir):
    runs, refs = _scored(spark, sf_dir)
    return evaluate.ngram_scores(runs, refs, "sample_id", ["result_id"], ["ref_idx"], 2, "default").withColumn("score", F.round("score", 6))


@query(_rouge_sql(1, _CHARS))
def rouge1_characters(spark, sf_dir):
    runs, refs = _scored(spark, sf_dir)
    return evaluate.ngram_scores(runs, refs, "sample_id", ["result_id"], ["ref_idx"], 1, "unicode_char").withColumn("score", F.round("score", 6))


@query(_rouge_sql(1, _WORDS))
def pair_rouge1(spark, sf_dir):
    """ROUGE-1 as the pipeline scores it."""
    runs, refs = _scored(spark, sf_dir)
    scored = evaluate.pair_scores(runs.withColumn("tokenizer", F.lit("default")), refs, "sample_id", ["result_id"], ["ref_idx"], ("rouge1",))
    return scored.select("result_id", "ref_idx", F.round("rouge1", 6).alias("score"))


@query(_rouge_sql(2, _WORDS))
def pair_rouge2(spark, sf_dir):
    """ROUGE-2 as the pipeline scores it."""
    runs, refs = _scored(spark, sf_dir)
    scored = evaluate.pair_scores(runs.withColumn("tokenizer", F.lit("default")), refs, "sample_id", ["result_id"], ["ref_idx"], ("rouge2",))
    return scored.select("result_id", "ref_idx", F.round("rouge2", 6).alias("score"))


@query()
def rouge_best_reference(spark, sf_dir):
    """ROUGE-1, -2 and -L against the best reference, by the language's tokenizer."""
    runs, refs = _scored(spark, sf_dir)
    kinds = table(spark, sf_dir, "results").groupBy("result_id").agg(F.min("dataset").alias("dataset"))
    language = F.when(F.col("dataset").isin("vn_mds", "vims"), "vi").when(F.col("dataset") == "multi_news", "en").otherwise("")
    told = runs.join(kinds, "result_id").withColumn("tokenizer", evaluate.tokenizer_for(language))
    return evaluate.best_scores(told, refs, "sample_id", ["result_id"])


_GROUPS = ["dataset", "run_mode", "salience", "alpha", "beta", "gamma", "chunking", "llm_model", "max_summary_words", "max_output_tokens"]
_NUMBERS = ["rouge1", "rouge2", "rougel", "input_tokens", "output_tokens", "llm_calls", "runtime_seconds", "chunk_count", "community_count"]
_RESULT = "SELECT dataset, run_mode, salience, alpha, beta, round(gamma, 6) AS gamma, chunking, llm_model, max_summary_words, max_output_tokens"
_MEAN = ", ".join(f"floor(avg(CAST({c} AS DOUBLE)) FILTER (WHERE NOT isnan(CAST({c} AS DOUBLE))) * 10000 + 0.50001) / 10000 AS mean_{c}" for c in _NUMBERS)


@query(f"""WITH one AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM results) {_RESULT}, count(*) AS n, {_MEAN} FROM one GROUP BY dataset, run_mode, salience, alpha, beta, round(gamma, 6), chunking, llm_model, max_summary_words, max_output_tokens""")
def aggregate_results(spark, sf_dir):
    """Means of the scores by setting; settings are compared without float noise.

    Rounded by a floor with a small surplus, so that a tie doesn't depend on the
    order of the sum."""
    rows = table(spark, sf_dir, "results").drop("loaded_at").distinct().withColumn("gamma", F.round("gamma", 6))
    out = evaluate.aggregate_results(rows, _GROUPS, _NUMBERS)
    return out.select(*_GROUPS, "n", *[(F.floor(F.col(f"mean_{c}") * 10000 + 0.50001) / 10000).alias(f"mean_{c}") for c in _NUMBERS])


@query("""WITH one AS (SELECT call_id, any_value(sample_id) AS sample_id, any_value(step_type) AS step_type, max(input_tokens) AS i, max(output_tokens) AS o, max(calls) AS c FROM llm_results GROUP BY call_id)
SELECT sample_id, step_type, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(c) AS BIGINT) AS calls FROM one GROUP BY sample_id, step_type""")
def token_usage(spark, sf_dir):
    """Tokens and calls of each sample and step, deliveries that were repeated counted once."""
    one = table(spark, sf_dir, "llm_results").groupBy("call_id").agg(
        F.any_value("sample_id").alias("sample_id"), F.any_value("step_type").alias("step_type"), F.max("input_tokens").alias("i"), F.max("output_tokens").alias("o"), F.max("calls").alias("c")
    )
    return one.groupBy("sample_id", "step_type").agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum(F.col("c").cast("long")).alias("calls"))


@query("""SELECT d.sample_id, any_value(d.dataset) AS dataset, count(DISTINCT d.doc_id) AS documents, any_value(r.n) AS reference_count FROM documents d
JOIN (SELECT sample_id, count(*) AS n FROM ref_texts WHERE regexp_matches(text, '[^\\s\\p{Z}]') GROUP BY sample_id) r USING (sample_id) WHERE regexp_matches(d.text, '[^\\s\\p{Z}]') GROUP BY d.sample_id""")
def samples(spark, sf_dir):
    """Samples with at least one document and one reference that aren't blank."""
    from docloom.sources.clusters import sample_list

    return sample_list(_docs(spark, sf_dir), table(spark, sf_dir, "ref_texts"))


# ------------------------------------------------------- prompts and readers


@query(f"""WITH j AS (SELECT doc_id, coalesce(text, '') || '|||||' || coalesce(title, '') || '||||| ' AS d FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, list_filter(list_transform(string_split(d, '|||||'), lambda x: {_strip('x')}), lambda x: x <> '') AS parts, d FROM j),
f AS (SELECT doc_id, CASE WHEN len(parts) > 0 THEN parts ELSE [d] END AS parts FROM p)
SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS doc_ord, unnest(parts) AS text FROM f""")
def multi_doc_split(spark, sf_dir):
    """Documents joined by the separator of the table layout and split again."""
    from docloom.sources.clusters import split_documents

    d = _docs(spark, sf_dir).where("doc_id is not null")
    joined = F.concat(F.coalesce("text", F.lit("")), F.lit("|||||"), F.coalesce("title", F.lit("")), F.lit("||||| "))
    return d.select("doc_id", F.posexplode(split_documents(joined)).alias("doc_ord", "text"))


@query("""SELECT result_id, CASE WHEN dataset IN ('vn_mds', 'vims') THEN 'Vietnamese' ELSE 'English' END AS language,
CASE WHEN max_summary_words > 0 THEN 'At most ' || max_summary_words || ' words, ending with a whole sentence.' ELSE 'No limit on length.' END AS length_rule,
coalesce(CASE dataset WHEN 'vn_mds' THEN 180 WHEN 'vims' THEN 235 WHEN 'multi_news' THEN 260 END, 0) AS default_words FROM (SELECT DISTINCT result_id, dataset, max_summary_words FROM results)""")
def prompt_rules(spark, sf_dir):
    """Language, length rule and default budget of each run."""
    from docloom.plans import prompts

    r = table(spark, sf_dir, "results").select("result_id", "dataset", "max_summary_words").distinct()
    lang = F.when(F.col("dataset").isin("vn_mds", "vims"), "vi").otherwise("en")
    words, _ = pipeline.budgets(F.col("dataset"), REPORTED)
    return r.select("result_id", TX.language_name(lang).alias("language"), prompts.length_rule(F.col("max_summary_words")).alias("length_rule"), F.coalesce(words, F.lit(0)).alias("default_words"))


@query(f"""SELECT sample_id, {_strip("string_agg(coalesce(block, ''), E'\n\n' ORDER BY doc_ord)")} AS block FROM (SELECT sample_id, doc_ord,
  '[Document ' || row_number() OVER (PARTITION BY sample_id ORDER BY doc_ord, document_id) || ': ' || document_id || ']' || CASE WHEN coalesce(title, '') <> '' THEN E'\nTitle: ' || title ELSE '' END
  || CASE WHEN coalesce(source, '') <> '' THEN E'\nSource: ' || source ELSE '' END || E'\n' || coalesce(text, '') AS block FROM documents WHERE sample_id IS NOT NULL) GROUP BY sample_id""")
def prompt_blocks(spark, sf_dir):
    """The source block, cut out of each sample's direct prompt again."""
    asked = pipeline.direct_prompts(_docs(spark, sf_dir), REPORTED)
    return asked.select("sample_id", TX.prompt_block(F.col("prompt"), "Source documents").alias("block"))


@query(ORACLES["duplicate_groups"].replace("SELECT label, vec_id, leader AS representative, vec_id = leader AS is_representative FROM sized WHERE n > 1", """
SELECT label, vec_id % 3 AS community, vec_id, row_number() OVER (PARTITION BY label, vec_id % 3, CASE WHEN n > 1 THEN leader ELSE -vec_id - 1 END
  ORDER BY (n > 1 AND vec_id = leader) DESC, vec_id) = 1 AS kept FROM sized"""))
def community_dedup(spark, sf_dir):
    """Communities vec_id mod 3: of each duplicate group one stays."""
    v = _vectors(spark, sf_dir)
    groups = dedup.duplicate_groups(v, "label", "vec_id", [], "embedding", 0.3)
    members = v.select("label", (F.col("vec_id") % 3).alias("community"), "vec_id")
    return dedup.community_representatives(members, groups, ["label", "community"], "vec_id", "vec_id").select("label", "community", "vec_id", "kept")


# ------------------------------------------------------------------ pipelines


def _case(column: str, table_: dict[str, str], other: str) -> str:
    if not table_:
        return other
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table_.items()) + f" ELSE {other} END"


_QUOTE = "'"
_HINT = _case("dataset", prompts.VIETNAMESE_HINTS, f"'{prompts.VIETNAMESE_HINT.replace(_QUOTE, _QUOTE * 2)}'")
_LIMIT = _case("dataset", {k: f"At most {v[0]} words, ending with a whole sentence." for k, v in SUMMARY_BUDGETS.items()}, "'No limit on length.'")
_BLOCK = """'[Document ' || CAST(n AS VARCHAR) || ': ' || document_id || ']' || CASE WHEN coalesce(title, '') <> '' THEN chr(10) || 'Title: ' || title ELSE '' END
  || CASE WHEN coalesce(source, '') <> '' THEN chr(10) || 'Source: ' || source ELSE '' END || chr(10) || coalesce(text, '')"""


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY doc_ord, document_id) AS n FROM documents WHERE sample_id IS NOT NULL),
s AS (SELECT sample_id, min(dataset) AS dataset, min(lower(substr(coalesce(lang, ''), 1, 2))) AS lang, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY n) AS body FROM d GROUP BY sample_id)
SELECT sample_id, 'Summarise the documents. Use only what the material below says. Write in ' || CASE WHEN lang = 'vi' THEN 'Vietnamese' ELSE 'English' END || '.' || chr(10)
  || CASE WHEN lang = 'vi' THEN {_HINT} ELSE 'Nothing beyond the rules above.' END || chr(10) || {_LIMIT}
  || chr(10) || chr(10) || 'Source documents:' || chr(10) || '---' || chr(10) || {_strip("body")} || chr(10) || '---' AS prompt FROM s""")
def direct_prompts(spark, sf_dir):
    return pipeline.direct_prompts(_docs(spark, sf_dir), REPORTED).select("sample_id", "prompt")


def _relation(spark, sf_dir, name: str) -> DataFrame:
    """One relation of a run without pairs of chunks or a summariser."""
    docs = pipeline.prepare(_docs(spark, sf_dir))
    return trace.text_relations(docs)[name]


@query(f"""WITH {_SENTENCES} SELECT d.sample_id, d.document_id || ':s' || s.sent_index AS splitter_output_id, d.document_id, d.document_id || ':p' || s.paragraph_idx AS paragraph_id,
  s.sent_index AS index, s.text FROM sent s JOIN documents d USING (doc_id) WHERE d.sample_id IS NOT NULL""")
def trace_splitter_outputs(spark, sf_dir):
    return _relation(spark, sf_dir, "splitter_outputs").withColumn("index", F.col("index").cast("long"))


@query(f"""WITH {_UNITS}, ids AS (SELECT doc_id, sent_index, string_agg(sent_index, ',') OVER (PARTITION BY doc_id ORDER BY sent_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS list FROM sent)
SELECT d.sample_id, d.document_id || ':u' || u.center AS segment_id, d.document_id, u.center AS center_index,
  array_to_string(list_transform(string_split(ids.list, ','), lambda i: d.document_id || ':s' || i), ', ') AS splitter_output_ids, u.text
FROM unit u JOIN ids ON ids.doc_id = u.doc_id AND ids.sent_index = u.center JOIN documents d ON d.doc_id = u.doc_id WHERE d.sample_id IS NOT NULL""")
def trace_segments(spark, sf_dir):
    return _relation(spark, sf_dir, "segments").withColumn("center_index", F.col("center_index").cast("long"))


@query()
def direct_summary(spark, sf_dir):
    return pipeline.score(pipeline.direct(_docs(spark, sf_dir), REPORTED), table(spark, sf_dir, "ref_texts"), "default").drop("error")


@query()
def e2e_summary(spark, sf_dir):
    run = pipeline.run(_docs(spark, sf_dir), REPORTED)
    return pipeline.score(run.summaries, table(spark, sf_dir, "ref_texts"))


@query()
def trace_relations(spark, sf_dir):
    """Rows of each provenance relation of a run."""
    relations = trace.trace(pipeline.run(_docs(spark, sf_dir), REPORTED))
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows") for name, df in sorted(relations.items())]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@query()
def summary_graph_dot(spark, sf_dir):
    relations = trace.trace(pipeline.run(_docs(spark, sf_dir), REPORTED))
    return trace.dot(relations["summary_graph_nodes"], relations["summary_graph_edges"])
