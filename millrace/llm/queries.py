"""The registered queries of the operators, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cover_tree,
    cross_entropy,
    edit_counts,
    hash_forest,
    knn_quality,
    mixture,
    phrases,
    piece_bpe,
    prefix_trie,
    preference,
    simhash,
    topk,
    warc,
)
from .common import stage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def piece_model() -> str:
    """The model file; the package that holds it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op4_piece_encoding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.token_digests(docs, piece_model())


#: Weights by level; a name that is not listed weighs 1.
MIX_WEIGHTS = [
    ("domain", "d0", 4), ("domain", "d1", 3), ("domain", "d2", 2), ("domain", "d3", 1),
    ("lang", "en", 4), ("lang", "de", 3), ("lang", "fr", 2), ("lang", "es", 2),
]
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (4, 5), 3, 6
_DOMAIN = (
    "CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '4' THEN 'd0' "
    "WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'd1' "
    "WHEN substr(md5(coalesce(source, '')), 1, 1) < 'c' THEN 'd2' ELSE 'd3' END"
)


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "level string, name string, weight long")


def mixed(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    return mixture.mix(docs, F.expr(_DOMAIN), mix_weights(spark), MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def _fill_sql(name: str, children: str, parent: str, level: str) -> str:
    """One level of budgets: ``children`` has parent columns, the level, room, weight and the parent's budget."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"ORDER BY CASE WHEN weight > 0 THEN CAST(room AS DOUBLE) / CAST(weight AS DOUBLE) END NULLS LAST, {level}"
    return f"""
{name}_m AS (SELECT *, coalesce(sum(room) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
    sum(weight) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM {children}),
{name}_f AS (SELECT *, room * rest_w <= (budget - bef) * weight AS filled FROM {name}_m),
{name}_l AS (SELECT *, budget - coalesce(sum(CASE WHEN filled THEN room END) OVER ({by}), 0) AS remaining,
    sum(CASE WHEN NOT filled THEN weight END) OVER ({by}) AS open_w FROM {name}_f),
{name} AS (SELECT *, CASE WHEN filled THEN room WHEN open_w > 0 THEN (remaining * weight) // open_w ELSE 0 END AS given
    FROM {name}_l)"""


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {w}" for at, n, w in MIX_WEIGHTS if at == level)
    return f"CAST(CASE {level} {cases} ELSE 1 END AS HUGEINT)" if cases else "CAST(1 AS HUGEINT)"


MIX_SQL = f"""
WITH sized AS (SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{mixture.WORD}')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM sized GROUP BY ALL),
n3 AS (SELECT domain, lang, source, tokens * {MIX_EPOCHS} AS room, {_weight_sql("source")} AS weight FROM leaves),
n2 AS (SELECT domain, lang, CAST(sum(room) AS HUGEINT) AS room, {_weight_sql("lang")} AS weight FROM n3 GROUP BY domain, lang),
n1 AS (SELECT domain, CAST(sum(room) AS HUGEINT) AS room, {_weight_sql("domain")} AS weight FROM n2 GROUP BY domain),
c1 AS (SELECT *, least((SELECT sum(room) FROM n1), (SELECT sum(tokens) * {MIX_SHARE[0]} // {MIX_SHARE[1]} FROM leaves)) AS budget
    FROM n1),{_fill_sql("g1", "c1", "", "domain")},
c2 AS (SELECT n2.*, given AS budget FROM n2 JOIN (SELECT domain, given FROM g1) USING (domain)),
{_fill_sql("g2", "c2", "domain", "lang")},
c3 AS (SELECT n3.*, given AS budget FROM n3 JOIN (SELECT domain, lang, given FROM g2) USING (domain, lang)),
{_fill_sql("g3", "c3", "domain, lang", "source")},
turns AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole,
    CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS remainder FROM g3 JOIN leaves USING (domain, lang, source)),
placed AS (SELECT s.*, whole, remainder, md5('{MIX_SEED}|' || CAST(whole AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)) AS h
    FROM sized s JOIN turns USING (domain, lang, source)),
cut AS (SELECT *, whole + CASE WHEN coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < remainder THEN 1 ELSE 0 END AS times FROM placed)
SELECT doc_id, CAST(unnest(generate_series(0, CAST(times AS BIGINT) - 1)) AS BIGINT) AS epoch, n_tokens FROM cut WHERE times > 0
"""


@query("op6_source_mixture", MIX_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once for each epoch of its leaf that takes it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "epoch", "n_tokens")


@query("op7_simhash_groups")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups they form."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_quality_votes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by their labelled neighbours."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return knn_quality.score(docs, table(spark, sf_dir, "labels"), keep_text=False)


COVER_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(origin, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT origin, b FROM reach JOIN links ON node = a),
least AS (SELECT origin AS vec_id, min(node) AS component_id FROM reach GROUP BY origin)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM least
"""


@query("op8_vector_groups", COVER_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors."""
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


TOP_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op10_exact_top_k", TOP_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth id."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


WARC_SQL = """
WITH known AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM known),
last AS (SELECT *, max(CASE WHEN payload_bytes >= 1000 THEN page_id END) OVER (PARTITION BY payload_digest) AS top FROM sized)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM last
"""


@query("op2_warc_salvage", WARC_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page from the archives that were written of them."""
    parts = warc.write_archives(table(spark, sf_dir, "pages"))
    gap = F.raise_error(F.concat(F.lit("a page is missing, archive damaged: "), F.col("reason"))).cast("boolean")
    records = warc.read_archives(parts, with_payload=False).filter(F.when(F.col("reason").isNull(), True).otherwise(gap))
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def _completion_sql(turns: str) -> str:
    """Text and mask of turns (pair_id, turn, role, text) after the parting."""
    return f"""
SELECT pair_id, string_agg(piece, '' ORDER BY turn) AS completion,
    string_agg(CASE WHEN role = 'assistant' THEN (e - length(text) - 11)::VARCHAR || '-' || e::VARCHAR END, ' ' ORDER BY turn) AS mask
FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY pair_id ORDER BY turn) AS e
    FROM (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece FROM {turns})) GROUP BY pair_id"""


PAIR_SQL = f"""
WITH known AS (SELECT conv_id AS pair_id, turn, min({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}) AS t FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
one AS (SELECT pair_id, turn, t.role AS role, t.text AS text FROM known),
raw AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
replies AS (SELECT pair_id, max({{'turn': turn, 'text': text}}) AS r FROM raw WHERE role = 'assistant' GROUP BY 1),
two AS (SELECT pair_id, turn, min({{'role': role, 'text': text}}) AS t FROM (
    SELECT raw.* FROM raw LEFT JOIN replies USING (pair_id) WHERE coalesce(turn < r.turn, true)
    UNION ALL SELECT a.pair_id, a.r.turn, 'assistant', b.r.text FROM replies a JOIN replies b ON b.pair_id = a.pair_id + 1) GROUP BY ALL),
other AS (SELECT pair_id, turn, t.role AS role, t.text AS text FROM two),
both_sides AS (SELECT pair_id, turn, one.role IS NOT DISTINCT FROM other.role AND one.text IS NOT DISTINCT FROM other.text AS same
    FROM one FULL JOIN other USING (pair_id, turn)),
parted AS (SELECT pair_id, min(CASE WHEN NOT same THEN turn END) AS parting FROM both_sides GROUP BY 1),
prompts AS (SELECT pair_id, count(*) AS prompt_turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS prompt
    FROM one JOIN parted USING (pair_id) WHERE parting IS NULL OR turn < parting GROUP BY 1),
later_one AS (SELECT one.* FROM one JOIN parted USING (pair_id) WHERE turn >= parting),
later_two AS (SELECT other.* FROM other JOIN parted USING (pair_id) WHERE turn >= parting),
c AS ({_completion_sql("later_one")}), r AS ({_completion_sql("later_two")})
SELECT pair_id, CAST(coalesce(prompt_turns, 0) AS INTEGER) AS prompt_turns, coalesce(prompt, '') AS prompt,
    coalesce(c.completion, '') AS chosen, coalesce(r.completion, '') AS rejected,
    coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM parted LEFT JOIN prompts USING (pair_id) LEFT JOIN c USING (pair_id) LEFT JOIN r USING (pair_id)
"""


def _spans(mask: str) -> Column:
    return F.concat_ws(" ", F.transform(mask, lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))))


@query("op3_preference_pairs", PAIR_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the next one's reply; masks as ``from-to`` separated by spaces."""
    pairs = preference.format_pairs(*preference.reply_pairs(table(spark, sf_dir, "conversations")))
    return pairs.withColumns({m: _spans(m) for m in ("chosen_mask", "rejected_mask")})


@query("op1_cross_entropy")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the target is what the labels call good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return cross_entropy.score(table(spark, sf_dir, "documents"), good)


def _edits(first: int) -> Column:
    """A replacement, an insertion and a deletion at places given by hashes, from the text itself."""
    place = lambda n: f"pmod(xxhash64(doc_id, {first + n}), length(text) + 1)"
    part = lambda n, size: f"substring(text, CAST({place(n)} AS INT), {size})"
    return F.expr(f"""array(
    named_struct('at', {place(1)}, 'deleted', 12L, 'inserted', {part(2, 20)}),
    named_struct('at', {place(3)}, 'deleted', 0L, 'inserted', {part(4, 40)}),
    named_struct('at', {place(5)}, 'deleted', 25L, 'inserted', ''))""")


@query("op5_edit_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after two batches of three edits; the second starts from the kept trees."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') AS text")
    planted = stage(edit_counts.plant(docs.withColumn("edits", _edits(0)), ranks, pattern, edits="edits"), "trees")
    earlier = [F.col(c).alias(f"first_{c}") for c in edit_counts.COUNTED]
    again = planted.select("doc_id", "text", *edit_counts.KEPT, *earlier, _edits(10).alias("edits"))
    counted = edit_counts.apply_edits(again, ranks, pattern)
    return counted.select(
        "doc_id", F.col("first_n_tokens_before").alias("n_tokens_before"), "first_n_tokens", "n_tokens",
        (F.col("first_n_edits") + F.col("n_edits")).alias("n_edits"), "first_counted_again", "counted_again",
        F.length("text").cast("long").alias("n_chars"),
    )


PHRASE_SQL = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
cut_texts AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM cut_texts),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(range(1, CAST(len(ws) AS BIGINT) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {phrases.SUPPORT}),
cuts AS (SELECT lang, phrase, a, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:], ' ') AS tail
    FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, c, h.a AS l, t.a AS r,
    (CAST(1000000 AS HUGEINT) * cuts.a * cuts.a) // (CAST(h.a AS HUGEINT) * t.a) AS score
    FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase, max(a) AS a
    FROM f, (SELECT unnest([1, 2]) AS i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= {phrases.TOP}
"""


@query("op11_phrase_collocations", PHRASE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


_TURN = "md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
TRIE_SQL = f"""
WITH turns AS (SELECT conv_id, {_TURN} AS m, strlen(coalesce(text, '')) AS b,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(m ORDER BY i) AS ms, list(b ORDER BY i) AS bs FROM turns GROUP BY conv_id),
bits AS (SELECT list(v ORDER BY byte) AS t FROM (SELECT byte, list_reduce(list_prepend(byte, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(byte))),
firsts AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 9 AS h FROM own, bits),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.ms, [])[1:h], o.ms[h + 1:]) AS ms, list_concat(coalesce(b.bs, [])[1:h], o.bs[h + 1:]) AS bs
    FROM own o JOIN firsts USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
steps AS (SELECT conv_id, d, len(ms) AS n, coalesce(array_to_string(ms[1:d], ''), '') AS k, bs[d] AS b
    FROM (SELECT *, unnest(range(0, CAST(len(ms) AS BIGINT) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(b), 0) AS b,
    sha256(coalesce(string_agg(CASE WHEN d = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM steps GROUP BY k, d),
children AS (SELECT substr(k, 1, 32 * (d - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
sums AS (SELECT substr(k, 1, 32 * above) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS above FROM known) GROUP BY 1)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM known c JOIN sums USING (k) LEFT JOIN known p ON c.d > 0 AND p.k = substr(c.k, 1, 32 * (c.d - 1))
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of conversations that begin as the first of their five does."""
    conv = F.col("conv_id")
    first = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), first, conv - conv % 5)


@query("op13_hash_forest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of all vectors that a forest finds for every twentieth id."""
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
