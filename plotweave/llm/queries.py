"""One query per operator over the whole given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.audit import CAPITALS, interactions, mask_counts
from plotweave.llm.decontaminate import indexes_of, with_hits
from plotweave.llm.hyperminhash import near_duplicates
from plotweave.llm.linefreq import line_quality
from plotweave.llm.merkle import build_manifest, folded, leaf_digest, proof_digest, proofs
from plotweave.llm.mixing import mix_sources
from plotweave.llm.packing import ids_crc32, pack_sequences
from plotweave.llm.pii import find_personal_data, personal_digest
from plotweave.llm.quality import fit_quality, in_held_out, with_quality
from plotweave.llm.secrets import find_secrets, secrets_digest
from plotweave.llm.toolcalls import MESSAGE_SCHEMAS, link_calls, message_calls
from plotweave.llm.toxicity import fit_toxicity, with_toxicity
from plotweave.llm.winnow import repeated_lines, repeated_passages
from plotweave.session import configure

Query = Callable[[SparkSession, str], DataFrame]

LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with batches small enough for whole texts, and Bloom filters of ids before shuffles of texts of any size."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    return spark


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        LLM_QUERIES[name] = lambda spark, sf_dir: build(prepared(spark), sf_dir)
        if sql is not None:
            LLM_ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_mix_sources", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))) AS seed,
         greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))
                  / greatest(length(coalesce(text, '')), 1)) AS quality
  FROM documents),
keyed AS (SELECT *, -ln((('0x' || substr(md5(seed), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / quality AS k FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER o AS turn,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
final AS (SELECT coalesce(arg_min(lvl, turn) FILTER (WHERE cap / w >= lvl), 0::DOUBLE) AS lvl FROM levels),
targets AS (SELECT l.source, source_size, least(cap::DOUBLE, final.lvl * w) AS target FROM levels l, final),
placed AS (
  SELECT k.*, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k.k, doc_id, seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
""")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_line_frequency", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
raw AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d)
        WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
norm AS (SELECT rid, source, text, unnest(string_split(regexp_replace(regexp_replace(lower(text), '[0-9]', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) AS x FROM d),
lines AS (SELECT DISTINCT rid, source, text, trim(x, ' ') AS x FROM norm WHERE trim(x, ' ') <> ''),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
common AS (SELECT l.source, x FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
           GROUP BY l.source, x HAVING count(DISTINCT text) > 10 AND count(DISTINCT text) * 1000 > any_value(n) * 5),
per AS (SELECT rid, sum(len(string_split(l.x, ' ')))::BIGINT AS line_words,
               coalesce(sum(len(string_split(l.x, ' '))) FILTER (WHERE c.x IS NOT NULL), 0)::BIGINT AS removed_words
        FROM lines l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.x = c.x GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(raw.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             coalesce(line_words, 0)::BIGINT AS line_words, coalesce(removed_words, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN raw USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN per USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * (line_words - removed_words) >= 30 * line_words AS kept FROM f
""")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


@query("op3_hyperminhash", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
          JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = d.doc_id
""")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


@query("op1_personal_data")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(find_personal_data(table(spark, sf_dir, "documents")))


@query("op10_markov_secrets")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(find_secrets(table(spark, sf_dir, "documents")))


@query("op7_winnow_lines")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = repeated_lines(docs)
    passages = repeated_passages(docs).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "passages", F.col("n_words").alias("_n_words"))
    both = found.join(passages, found["doc_id"].eqNullSafe(passages["_id"]) & (found["text_hash"] == passages["_th"]), "left")
    return both.select(
        "doc_id", "n_lines", F.size("lines").cast("bigint").alias("n_removed"), F.col("n_words").alias("n_removed_words"),
        F.array_join(F.transform("lines", lambda i: i.cast("string")), ",").alias("removed_lines"),
        F.coalesce("_n_words", F.lit(0)).cast("bigint").alias("n_passage_words"),
        F.coalesce(F.array_join(F.transform("passages", lambda x: F.concat_ws("-", x["a"], x["b"])), ","), F.lit("")).alias("removed_passages"))


#: Least score of documents that pass.
LEAST_QUALITY = 0.3


@query("op5_quality_network")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= LEAST_QUALITY, 1).otherwise(0).alias("predicted"))


@query("op8_toxicity_chain")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = with_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "p_severe", "p_mild", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


@query("op6_benchmark_hits")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), indexes_of(table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", F.explode("hits").alias("h")).select(
        "doc_id", "h.item_id", "h.score", "h.question", "h.answer", F.lit(True).alias("contaminated"))


@query("op9_tool_calls")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*message_calls(table(spark, sf_dir, "conversations")), MESSAGE_SCHEMAS)


#: The file of the tokenizer that counts tokens, of those that :mod:`public_tokenizers` names.
TOKENIZER = "word_bpe_49k.json"


@query("op11_pack_sequences")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", ids_crc32(F.col("ids")).alias("ids_crc32"), "sequence_id", "offset")


@query("op12_merkle_manifest", r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8)),
d AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS altered
  FROM (SELECT d.*, c.crc FROM documents d LEFT JOIN crcs c ON d.doc_id IS NOT DISTINCT FROM c.doc_id)),
hashed AS (
  SELECT doc_id, source, sha256(a || b || c || e || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(a || b || c || e || coalesce(strlen(altered) || ':' || altered, '-')) AS changed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS a, coalesce(strlen(source) || ':' || source, '-') AS b,
               coalesce(strlen(lang) || ':' || lang, '-') AS c, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS e FROM d)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed),
up AS (
  SELECT source, 0 AS h, pos, leaf AS digest, n FROM leaves
  UNION ALL SELECT source, h + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY source, h, pos // 16),
tops AS (SELECT source, h AS depth, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (
  SELECT 0 AS h, pos, subroot AS digest, n FROM tops
  UNION ALL SELECT h + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM over WHERE n > 1 GROUP BY h, pos // 16),
run AS (SELECT source, h, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM up WHERE n > 1 GROUP BY source, h, pos // 16),
top_run AS (SELECT h, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM over WHERE n > 1 GROUP BY h, pos // 16),
start AS (SELECT row_number() OVER () AS rid, l.doc_id, l.leaf, l.changed, l.source, l.pos, t.depth, t.subroot, t.pos AS top FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source),
fold AS (
  SELECT rid, source, 0 AS h, pos, depth, top, changed AS digest, '' AS others FROM start
  UNION ALL SELECT rid, f.source, f.h + 1, f.pos // 16, depth, top, sha256(array_to_string(kids[:f.pos % 16], '') || digest || array_to_string(kids[f.pos % 16 + 2:], '')),
                   others || array_to_string(kids[:f.pos % 16], '') || array_to_string(kids[f.pos % 16 + 2:], '')
            FROM fold f JOIN run r ON f.source IS NOT DISTINCT FROM r.source AND f.h = r.h AND f.pos // 16 = r.run),
top_fold AS (
  SELECT rid, 0 AS h, top AS pos, digest, others FROM fold WHERE h = depth
  UNION ALL SELECT rid, f.h + 1, f.pos // 16, sha256(array_to_string(kids[:f.pos % 16], '') || digest || array_to_string(kids[f.pos % 16 + 2:], '')),
                   others || array_to_string(kids[:f.pos % 16], '') || array_to_string(kids[f.pos % 16 + 2:], '')
            FROM top_fold f JOIN top_run r ON f.h = r.h AND f.pos // 16 = r.run),
top AS (SELECT h, digest AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM start JOIN top_fold USING (rid) JOIN top USING (h)
""")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: [*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text]
    lower = F.translate("text", CAPITALS, CAPITALS.lower())
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(*fields(lower)))
    leaves = docs.select("doc_id", "source", leaf_digest(*fields(F.col("text"))).alias("leaf"), altered.alias("altered"))
    found = proofs(build_manifest(leaves, "source", ["doc_id"]))
    told = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        folded(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > least, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN first USING (t) LEFT JOIN marks ON d.doc_id = marks.doc_id),
counts AS (SELECT part, mask, count(*)::BIGINT AS n, sum(good)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM masks GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e
           WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit,
                 list_sum(list_transform(string_split(filter_order, ''), lambda c, i: CASE WHEN i < step THEN 1 << (ascii(c) - 65) ELSE 0 END))::INT AS earlier
          FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
told AS (
  SELECT part, filter_order, step::INT AS step, any_value(letter) AS letter,
         coalesce(sum(n) FILTER (WHERE mask & bit = 0 AND mask & earlier = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM told
""")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
