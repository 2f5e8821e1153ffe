"""The queries op1_ to op13_ and their SQL. Each is thin: the operator's output, and digests derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, common, decontaminate, exact_dedup, fill_middle, html_text, near_dup, pii, role_repair, token_counts, token_files, toxicity, url_filter
from .common import table

#: A key for the registered query only; callers bring their own secret.
DEMO_KEY = b"demonstration key, not a secret"
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.shared_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, _tokenizer("byte_bpe_50k.json"), end_id=0)
    rows = token_files.read_token_files(spark, out)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


CONTROL = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    out = common.shared_dir(spark, "chat")
    chat.chat_format(chat.linear_messages(said.unionByName(extra))).write.parquet(out)
    rows = chat.read_chat(spark, out)
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256)
    return rows.select(
        chat.conversation_id(F.col("tree")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"),
    )


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)
    return out.select("doc_id", "text", F.size("values").cast("long").alias("n_values"), "values")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = url_filter.page_outcomes(pages, table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def held_out(key) -> F.Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), where=lambda key: ~held_out(key))
    rows = toxicity.score(docs, model, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    rank_file = _tokenizer("byte_bpe_50k.tiktoken")
    rows = bpe.bpe_round_trip(docs, rank_file)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def damaged(said: DataFrame) -> DataFrame:
    """Conversations with faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a turn, 1 empties it, 2 takes its ends of sentences, 3 repeats
    it, 4 makes it the user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = said.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = role_repair.repair(damaged(said))
    every = said.groupBy("conv_id").agg(F.lit(0).alias("none"))
    told = every.select(F.col("conv_id").alias("id"))
    for part in (found.report, found.digests):
        told = told.join(part, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42)
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_chat_format, op3_pii_pseudonyms, op4_decontaminate, op5_jaccard_join, op6_url_reputation, op7_toxicity, op8_html_text, op9_bpe_roundtrip, op10_exact_dedup, op11_token_counts, op12_role_repair, op13_fill_middle)}



def _step(way: str, cost: str, edit: str) -> str:
    """In SQL: a way (its cost in nine digits, then its audit) after one more edit."""
    return f"(lpad(CAST(CAST(left({way}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{edit}')"


_ESC = r"replace(replace(replace({}, '\', '\\'), '#', '\#'), '</', '<\/')"

ORACLES = {
    "op2_chat_format": rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}'
  UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(replace({_ESC.format('role')}, ':', '\:')) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id""",
    "op6_url_reputation": r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts),
named AS (
  SELECT *, list_extract(string_split(host, '.'), -1) AS suffix,
    CASE WHEN len(string_split(host, '.')) < 2 THEN host
         ELSE list_extract(string_split(host, '.'), -2) || '.' || list_extract(string_split(host, '.'), -1) END AS domain,
    TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1), '') AS BIGINT) AS doc_id
  FROM ruled),
marks AS (
  SELECT doc_id, min(CASE WHEN quality > 0 AND toxic <= 0 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS x
  FROM named JOIN marks USING (doc_id) WHERE good IS NOT NULL GROUP BY host),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(x) AS x FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM d GROUP BY suffix),
a AS (SELECT (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m, coalesce(sum(n), 0) AS n FROM s),
sp AS (SELECT s.*, a.m AS prior FROM s, a),
sk AS (SELECT CASE WHEN count(*) = 0 OR sum(prior*(1-prior)*n) <= sum(prior*(1-prior)) THEN 10.0 ELSE 1 / least(greatest(
    (sum(n*pow(x/n-prior,2)) - sum(prior*(1-prior))) / (sum(prior*(1-prior)*n) - sum(prior*(1-prior))), 1e-3), 0.99) - 1 END AS k FROM sp),
sm AS (SELECT sp.*, (k*prior+x)/(k+n) AS m, k+n AS w FROM sp, sk),
dp AS (SELECT d.*, sm.m AS prior FROM d JOIN sm USING (suffix)),
dk AS (SELECT CASE WHEN count(*) = 0 OR sum(prior*(1-prior)*n) <= sum(prior*(1-prior)) THEN 10.0 ELSE 1 / least(greatest(
    (sum(n*pow(x/n-prior,2)) - sum(prior*(1-prior))) / (sum(prior*(1-prior)*n) - sum(prior*(1-prior))), 1e-3), 0.99) - 1 END AS k FROM dp),
dm AS (SELECT dp.*, (k*prior+x)/(k+n) AS m, k+n AS w FROM dp, dk),
hp AS (SELECT h.*, dm.m AS prior FROM h JOIN dm USING (domain)),
hk AS (SELECT CASE WHEN count(*) = 0 OR sum(prior*(1-prior)*n) <= sum(prior*(1-prior)) THEN 10.0 ELSE 1 / least(greatest(
    (sum(n*pow(x/n-prior,2)) - sum(prior*(1-prior))) / (sum(prior*(1-prior)*n) - sum(prior*(1-prior))), 1e-3), 0.99) - 1 END AS k FROM hp),
hm AS (SELECT hp.*, (k*prior+x)/(k+n) AS m, k+n AS w FROM hp, hk)
SELECT page_id, named.host, path, rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN coalesce(hm.m + 1.6448536269514722*sqrt(hm.m*(1-hm.m)/(hm.w+1)), dm.m + 1.6448536269514722*sqrt(dm.m*(1-dm.m)/(dm.w+1)),
      sm.m + 1.6448536269514722*sqrt(sm.m*(1-sm.m)/(sm.w+1)), CASE WHEN a.n = 0 THEN 1.0 ELSE a.m + 1.6448536269514722*sqrt(a.m*(1-a.m)/(a.n+3)) END) < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM named CROSS JOIN a LEFT JOIN hm ON named.host = hm.host LEFT JOIN dm ON named.domain = dm.domain LEFT JOIN sm ON named.suffix = sm.suffix""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op13_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
c AS (
  SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(one, two)], '') AS prefix,
    array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle, array_to_string(units[greatest(one, two) + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""",
    "op12_role_repair": rf"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keyed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1))), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind
  FROM filled),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM damaged),
faulty AS (
  SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
r AS (
  SELECT *, NOT blank AND NOT again AS free, NOT blank AND NOT again AND last NOT IN ('.', '!', '?') AS cut,
    CASE WHEN NOT blank AND NOT again THEN CASE WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END END AS t FROM faulty),
chart(conv_id, pos, s, y, o, p) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), '000000003I', '000000006II' FROM r
  UNION ALL
  SELECT conv_id, pos, s, y, o, least(p, {_step('o', '3', 'I')}) FROM (
    SELECT conv_id, pos, s, y, least(o, {_step('least(s, y, p)', '3', 'I')}) AS o, p FROM (
      SELECT r.conv_id, r.pos, {_step('s', '4', 'D')} AS s,
        least({_step('y', '4', 'D')}, {_step('s', "CASE WHEN i = 's' THEN t END", 'K')}) AS y,
        least({_step('o', '4', 'D')}, {_step('least(s, y, p)', "CASE WHEN i = 'u' THEN t END", 'K')}, {_step('least(s, y, p)', '3 + t', 'R')}) AS o,
        least({_step('p', '4', 'D')}, {_step('o', "CASE WHEN i = 'a' THEN t END", 'K')}, {_step('o', '3 + t', 'R')}) AS p
      FROM chart JOIN r ON r.conv_id IS NOT DISTINCT FROM chart.conv_id AND r.pos = chart.pos + 1))),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
    count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, max(pos) AS n FROM r GROUP BY conv_id),
best AS (
  SELECT told.*, CAST(left(least(s, p), 9) AS BIGINT) AS cost, substr(least(s, p), 10) AS audit
  FROM told JOIN chart ON told.conv_id IS NOT DISTINCT FROM chart.conv_id AND told.n = chart.pos),
edits AS (
  SELECT conv_id, nth, audit[nth] AS e, len(replace(left(audit, nth), 'I', '')) AS pos, len(replace(left(audit, nth), 'D', '')) AS spot
  FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS nth FROM best)),
made AS (
  SELECT edits.*, r.role, r.text, max(CASE WHEN spot = 1 AND e = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY edits.conv_id) AS system
  FROM edits LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM edits.conv_id AND r.pos = edits.pos WHERE e <> 'D'),
text AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (spot - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY nth) AS repaired
  FROM made GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN text ON c.conv_id IS NOT DISTINCT FROM text.conv_id""",
}
