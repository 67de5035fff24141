"""The registered queries of this subpackage, each with the same question in SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage.llm import bottomk, decontaminate, filter_audit, importance, katz, licenses, line_dedup, mixture, periodic, pii, run_index, topk, toxicity
from acreage.llm.common import Scratch, table, text_key


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), Scratch(spark, "lines"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    def n(kind: str):
        return F.size(F.filter("found", lambda x: x["rule"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, pii.KINDS), "base_sha256", "spans")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "importance")).select(
        "doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_grams", "log_weight", "sample_key", "kept")))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan_licenses(docs, Scratch(spark, "licenses")).groupBy("id", "text_key").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count("*").alias("n"), F.max("probability").alias("probability"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_key"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("_key").eqNullSafe(F.col("text_key")), "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"), "probability")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "bottomk"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark, "runs")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"), Scratch(spark, "katz"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(table(spark, sf_dir, "documents"), Scratch(spark, "mixture")).select(
        "doc_id", *(F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target")), (F.col("_size") * F.col("_copies")).alias("taken"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).select(
        "doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), Scratch(spark, "topk"), k=5, every=50)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "audit"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by a hash of the id, repeat part of their words to the end. A null id leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), lambda r: F.struct(
        r["w"].alias("w"), F.size(r["w"]).alias("n"), F.pmod(r["g"], F.size(r["w"])).cast("int").alias("a"), (F.pmod(r["g"], F.lit(8)) + 3).alias("parts")))[0]
    period = (F.floor((made["n"] - made["a"]) / made["parts"]) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(made["w"], made["a"] + 1, period), F.ceil((made["n"] - made["a"]) / period).cast("int")))
    repeated = F.array_join(F.concat(F.slice(made["w"], 1, made["a"]), F.slice(tail, 1, made["n"] - made["a"])), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))  # equal lengths: the smallest start
    length, start, period = best["length"], -best["col2"], -best["col3"]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))
    return found.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "first_word", "last_word")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (SELECT *, trim({_LOWER.format('line')}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""

#: Sets of runs of five words, pairs that share any, and everything that can be reached by links.
OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + least(5, len(w))], ' ') AS g FROM (SELECT *, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met.n >= 75 * (x.n + y.n - met.n)),
reach AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT b, root FROM reach JOIN links ON a = doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP8_BODY = """
d AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
             CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:9] AS BIGINT) AS unit FROM docs),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST(r % 3 AS INT) + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
f AS (SELECT *, most <= level * weight AS is_full FROM v),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE least(most, weight * (SELECT min_by(level, most / weight) FROM f WHERE NOT is_full)) END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
u AS (SELECT source, unit, sum(size) AS words FROM d GROUP BY ALL),
c AS (SELECT u.*, target - passes * source_size AS rest, sum(words) OVER (PARTITION BY u.source ORDER BY unit) AS upto
      FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source),
p AS (SELECT source, min(unit) AS unit, min_by(upto, unit) AS upto, min_by(words, unit) AS words, any_value(rest) AS rest FROM c WHERE upto > rest GROUP BY source),
m AS (SELECT d.*, source_size, target, passes + CASE WHEN b.target - b.passes * b.source_size > 0 AND
        (p.unit IS NULL OR d.unit < p.unit OR (d.unit = p.unit AND p.upto - p.rest < p.rest - (p.upto - p.words))) THEN 1 ELSE 0 END AS copies
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source)
"""

OP8_SQL = f"WITH docs AS (SELECT * FROM documents), {OP8_BODY} SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM m"

#: The words of texts, and the hits of benchmark windows in ``docs`` by document.
OP9_BODY = r"""
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT *, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM bn)),
lens AS (SELECT DISTINCT n FROM bn),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM docs),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, grams.n AS n, item_id FROM grams JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id),
judged AS (SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id))
"""

OP9_SQL = f"WITH docs AS (SELECT * FROM documents), {OP9_BODY} SELECT * FROM judged"

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
             + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
bits AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM bits a, bits b, bits c, bits d, bits e WHERE (a.b | b.b | c.b | d.b | e.b) = 31),
steps AS (SELECT filter_order, CAST(s AS INT) AS step, bs[s] AS bit, CAST(coalesce(list_sum(bs[1:s - 1]), 0) AS INT) AS before FROM orders, range(1, 6) r(s)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS removed,
             coalesce(sum(n) FILTER ((mask & before) > 0 AND (mask & bit) > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
             coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0 AND good), 0) AS good_lost, coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0 AND toxic), 0) AS toxic_lost
      FROM n, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

#: CRC-32 of a text of digits, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: " \
         "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v // 2, 3988292384 * (v % 2)))), 4294967295)"

#: Places with equal words at each distance, gathered to stretches; a stretch inside one of a period that divides its own is no run.
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, {_CRC32.format('doc_id')} AS h FROM documents),
g AS (SELECT doc_id, o, len(o) AS n, h // 10 AS g, h % 10 = 0 AND len(o) > 0 AS made FROM d),
p AS (SELECT *, CASE WHEN made THEN g % n END AS a, CASE WHEN made THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
t AS (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(0, n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END AS w FROM p),
x AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM t),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, q, min(i) AS start, max(i) + 1 + q AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island
      HAVING max(i) + 1 + q - min(i) >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, stop, stop - start AS length, q AS period FROM s WHERE NOT EXISTS
      (FROM s z WHERE z.doc_id = s.doc_id AND z.q < s.q AND s.q % z.q = 0 AND z.start <= s.start AND z.stop >= s.stop)),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, stop)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ENTRIES = {
    "op1_line_dedup": (op1_line_dedup, OP1_SQL),
    "op2_pii": (op2_pii, None),
    "op3_quality_classifier": (op3_quality_classifier, None),
    "op4_license_scans": (op4_license_scans, None),
    "op5_minhash_near_dedup": (op5_minhash_near_dedup, OP5_SQL),
    "op6_suffix_array_dedup": (op6_suffix_array_dedup, None),
    "op7_lm_scoring": (op7_lm_scoring, None),
    "op8_mixing": (op8_mixing, OP8_SQL),
    "op9_decontamination": (op9_decontamination, OP9_SQL),
    "op10_exact_top_k": (op10_exact_top_k, OP10_SQL),
    "op11_filter_audit": (op11_filter_audit, OP11_SQL),
    "op12_periodic_runs": (op12_periodic_runs, OP12_SQL),
    "op13_toxicity": (op13_toxicity, None),
}
