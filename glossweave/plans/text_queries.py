"""Queries on texts, lexicons and corpora, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions import text as tx
from glossweave.operators import corpus, lexicon, probing
from glossweave.operators import report
from glossweave.sources import adapters as ad

from .graph_queries import KG

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\r\f\v]+'), lambda t: t <> '')"
LINE_TOKENS = ad.LINES + f""", toks AS (SELECT doc_id, line_no, lang, unnest({WORDS.format('text')}) AS token, generate_subscripts({WORDS.format('text')}, 1) AS pos FROM lines)"""


def _line_tokens(spark, d, where="true"):
    lines = ad.corpus_lines(spark, d).where(where)
    return lines.select("doc_id", "line_no", "lang", F.posexplode(tx.words(F.col("text"))).alias("pos", "token"))


@query(rf"""WITH {LINE_TOKENS}, parts AS (SELECT *, regexp_extract(token, '^[.,]*', 0) AS lead FROM toks), rest AS (SELECT *, substr(token, length(lead) + 1) AS r FROM parts), cores AS (SELECT *, regexp_replace(r, '[.,]+$', '') AS core FROM rest)
SELECT doc_id, line_no, CAST(sum(length(lead) + length(r) - length(core) + CASE WHEN core <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_tokens,
md5(string_agg(array_to_string(list_concat(list_concat(list_filter(regexp_split_to_array(lead, ''), lambda c: c <> ''), CASE WHEN core <> '' THEN [core] ELSE [] END), list_filter(regexp_split_to_array(substr(r, length(core) + 1), ''), lambda c: c <> '')), ' '), ' ' ORDER BY pos)) AS digest FROM cores GROUP BY ALL""")
def edge_mark_tokens(spark, d):
    tokens = tx.tokens_with_marks(F.col("text"))
    return ad.corpus_lines(spark, d).withColumn("t", tokens).where(F.size("t") > 0).select("doc_id", "line_no", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(rf"WITH {ad.LINES} SELECT doc_id, line_no, md5(array_to_string(list_filter(list_transform({WORDS.format('text')}, lambda t: regexp_replace(regexp_replace(t, '^[.,;!?]+', ''), '[.,;!?]+$', '')), lambda t: t <> ''), ' ')) AS digest FROM lines")
def strip_symbols(spark, d):
    return ad.corpus_lines(spark, d).select("doc_id", "line_no", F.md5(tx.strip_symbols(F.col("text"))).alias("digest"))


@query(rf"""WITH {ad.LINES}, w AS (SELECT *, {WORDS.format('text')} AS ws FROM lines), p AS (SELECT *, list_position(ws, 'the') AS loc FROM w WHERE list_contains(ws, 'the'))
SELECT doc_id, line_no, md5(array_to_string(list_concat(list_concat(ws[1:loc - 1], ['[MASK]']), ws[loc + 1:]), ' ')) AS digest FROM p""")
def mask_first_occurrence(spark, d):
    masked = F.transform(F.array(tx.words(F.col("text"))), lambda w: tx.mask_first(w, F.lit("the")))  # the words are cut once
    own = ad.corpus_lines(spark, d).where(F.contains("text", F.lit("the"))).select("doc_id", "line_no", F.explode(F.array_compact(masked)).alias("m"))
    return own.select("doc_id", "line_no", F.md5("m").alias("digest"))


@query("""WITH raw AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Ab_' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') WHEN 1 THEN 'x_y_z_w' WHEN 2 THEN 'caf%C3%A9' ELSE 'a' || p_partkey END AS raw FROM part)
SELECT k, CASE k % 4 WHEN 0 THEN lower(replace(raw, '_', ' ')) WHEN 1 THEN 'x y z w' WHEN 2 THEN 'café' ELSE raw END AS lemma, CASE k % 4 WHEN 0 THEN lower(replace(raw, '_', ' ')) WHEN 2 THEN 'café' END AS clean FROM raw""")
def clean_lemma(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("Ab_"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))).when(k % 4 == 1, "x_y_z_w").when(k % 4 == 2, "caf%C3%A9").otherwise(F.concat(F.lit("a"), k.cast("string")))
    return ad.table(spark, d, "part").select(k.alias("k"), raw.alias("raw")).select("k", tx.normalize_lemma(F.col("raw")).alias("lemma"), tx.clean_lemma(F.col("raw")).alias("clean"))


_PARTS = """SELECT p_partkey AS k, p_partkey % 2 AS s1, p_partkey // 2 % 2 AS s2, p_partkey // 4 % 2 AS s3, ['TRANS', 'COP', 'COP_ADJ'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS kind, 's' || p_partkey AS subject, 't' || p_size AS target FROM part"""


@query(f"""WITH p AS ({_PARTS}), n AS (SELECT *, CASE WHEN s3 = 0 THEN 'big ' || subject ELSE subject || ' big' END AS s FROM p),
v AS (SELECT *, CASE kind WHEN 'TRANS' THEN CASE WHEN s2 = 1 THEN target || ' sees' ELSE 'sees ' || target END WHEN 'COP' THEN 'is near ' || target ELSE 'is close near ' || target END AS vp FROM n)
SELECT k, CASE WHEN s1 = 0 THEN CASE WHEN s2 = 0 THEN 'SVO' ELSE 'SOV' END ELSE CASE WHEN s2 = 0 THEN 'VOS' ELSE 'OVS' END END AS name, CASE WHEN s1 = 0 THEN s || ' ' || vp ELSE vp || ' ' || s END AS sentence FROM v""")
def sentence_word_orders(spark, d):
    k = F.col("p_partkey")
    s1, s2, s3 = k % 2, F.floor(k / 2) % 2, F.floor(k / 4) % 2
    kind = F.element_at(F.array(F.lit("TRANS"), F.lit("COP"), F.lit("COP_ADJ")), (k % 3 + 1).cast("int"))
    subject = tx.with_adjective(F.concat(F.lit("s"), k.cast("string")), F.lit("big"), s3)
    said = tx.arrange(s1, s2, subject, kind, F.lit("sees"), F.lit("is"), F.lit("close"), F.lit("near"), F.concat(F.lit("t"), F.col("p_size").cast("string")))
    return ad.table(spark, d, "part").select(k.alias("k"), tx.word_order(s1, s2).alias("name"), said.alias("sentence"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size, ['V_HYPO', 'PP', 'CONJ2', 'AUX_X', 'ADJP_HYPO', 'N', 'VP'][CAST(p_partkey % 7 + 1 AS INTEGER)] AS symbol, ['overlap_050', 'low_40_relation', 'high_80_coverage', 'full'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS c FROM part)
SELECT k, CASE WHEN symbol LIKE 'ADJP%' THEN 'ADJP' WHEN symbol LIKE 'AUX%' THEN 'AUX' WHEN symbol LIKE 'CONJ%' THEN 'CONJ' WHEN symbol LIKE 'PP%' THEN 'PP' WHEN symbol LIKE 'V%' THEN 'V' ELSE symbol END AS base,
CASE WHEN c = 'overlap_050' THEN 50 END AS overlap, CASE WHEN c LIKE 'low!_40%' ESCAPE '!' THEN 40 WHEN c LIKE 'high!_80%' ESCAPE '!' THEN 80 ELSE 100 END AS density, CASE WHEN c LIKE '%!_relation' ESCAPE '!' THEN 'relation-first' WHEN c LIKE '%!_coverage' ESCAPE '!' THEN 'coverage-first' ELSE 'full' END AS strategy,
CAST(round_even(k * 0.25, 0) AS BIGINT) AS half_even, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE 100.0 * k / (p_size % 5) END AS percent, CAST(ceil(k / 32.0) AS BIGINT) AS steps, least(50, CAST(floor(k * 0.3) AS INTEGER)) AS quota FROM p""")
def scalar_functions(spark, d):
    k = F.col("p_partkey")
    symbol = F.element_at(F.array(*map(F.lit, ("V_HYPO", "PP", "CONJ2", "AUX_X", "ADJP_HYPO", "N", "VP"))), (k % 7 + 1).cast("int"))
    c = F.element_at(F.array(*map(F.lit, ("overlap_050", "low_40_relation", "high_80_coverage", "full"))), (k % 4 + 1).cast("int"))
    return ad.table(spark, d, "part").select(k.alias("k"), tx.base_pos(symbol).alias("base"), tx.overlap_percent(c).alias("overlap"), tx.density_percent(c).alias("density"), tx.strategy(c).alias("strategy"), tx.half_even(k * 0.25).alias("half_even"), tx.percent(k, F.col("p_size") % 5).alias("percent"), tx.steps_per_epoch(k, F.lit(32)).alias("steps"), tx.related_quota(k, F.lit(0.3), F.lit(50)).alias("quota"))


@query(f"WITH {LINE_TOKENS} SELECT doc_id, line_no, md5(array_to_string(list(token ORDER BY pos)[1:62], ' ')) AS digest FROM toks GROUP BY ALL")
def truncated_tokens(spark, d):
    return ad.corpus_lines(spark, d).withColumn("w", tx.words(F.col("text"))).where(F.size("w") > 0).select("doc_id", "line_no", F.md5(F.array_join(tx.truncate(F.col("w")), " ")).alias("digest"))


_FREQ = LINE_TOKENS + ", freq AS (SELECT token, count(*) AS n, min({'d': doc_id, 'l': line_no, 'p': pos}) AS first, row_number() OVER (ORDER BY count(*) DESC, min({'d': doc_id, 'l': line_no, 'p': pos}), token) AS place FROM toks GROUP BY token)"


def _frequency(spark, d):
    t = _line_tokens(spark, d)
    return corpus.token_frequency(t.select("token", F.struct("doc_id", "line_no", "pos").alias("position")))


@query(f"WITH {_FREQ} SELECT token, n, CAST(place AS INTEGER) AS place FROM freq")
def token_frequency(spark, d):
    return _frequency(spark, d).select("token", "n", "place")


@query(f"WITH {_FREQ} SELECT token, CASE WHEN place <= 10 THEN 'high' WHEN place <= 50 THEN 'mid' ELSE 'low' END AS band FROM freq WHERE place <= 200")
def frequency_band_tokens(spark, d):
    f = _frequency(spark, d)
    out = [corpus.band(f, a, b).select("token", F.lit(name).alias("band")) for name, (a, b) in corpus.BANDS.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_ANCHOR = _FREQ.replace("WITH ", "") + """, c AS (SELECT token, n, row_number() OVER (ORDER BY md5('1|anchor|' || token), token, n) AS i FROM freq WHERE place > 10 AND place <= 50), b AS (SELECT sum(n) * 0.05 AS budget FROM freq),
fold AS (SELECT 0::BIGINT AS i, 0::BIGINT AS s, NULL::VARCHAR AS token UNION ALL SELECT c.i, CASE WHEN fold.s + c.n <= budget THEN fold.s + c.n ELSE fold.s END, CASE WHEN fold.s + c.n <= budget THEN c.token END FROM fold JOIN c ON c.i = fold.i + 1, b)"""


@query(f"WITH RECURSIVE {_ANCHOR} SELECT token FROM fold WHERE token IS NOT NULL")
def anchor_selection(spark, d):
    return corpus.select_anchors(_frequency(spark, d), "mid", 0.05, 1)


_TRANS = LINE_TOKENS + ", " + ad.LEXICON + ", en AS (SELECT * FROM toks)"


def _sentence_tokens(spark, d):
    t = _line_tokens(spark, d)
    return t.select(F.concat_ws(":", "doc_id", "line_no").alias("sentence"), F.col("pos").alias("position"), "token")


@query(f"""WITH {_TRANS}, l AS (SELECT DISTINCT lang FROM lexicon), m AS (SELECT en.doc_id || ':' || en.line_no AS sentence, en.pos, l.lang, coalesce(artificial, CASE WHEN regexp_full_match(token, '[.,]') THEN token END) AS mapped FROM en CROSS JOIN l LEFT JOIN lexicon x ON x.lang = l.lang AND x.key = en.token)
SELECT sentence, lang, coalesce(string_agg(mapped, ' ' ORDER BY pos) FILTER (WHERE mapped IS NOT NULL), '') AS text, bool_and(mapped IS NOT NULL) AS complete FROM m GROUP BY sentence, lang""")
def lexicon_translate_drop_oov(spark, d):
    out = corpus.sentences(corpus.translate(_sentence_tokens(spark, d), ad.lexicon(spark, d), keep_unknown=False))
    return out


@query(rf"""WITH {_TRANS}, l AS (SELECT DISTINCT lang FROM lexicon), k AS (SELECT *, regexp_replace(regexp_replace(token, '^[,.;:!?]+', ''), '[,.;:!?]+$', '') AS key FROM en),
m AS (SELECT k.doc_id || ':' || k.line_no AS sentence, k.pos, l.lang, coalesce(artificial, k.key) AS mapped FROM k CROSS JOIN l LEFT JOIN lexicon x ON x.lang = l.lang AND x.key = k.key WHERE k.key <> '')
SELECT sentence, lang, string_agg(mapped, ' ' ORDER BY pos) AS text, true AS complete FROM m GROUP BY sentence, lang""")
def lexicon_translate_keep_oov(spark, d):
    return corpus.sentences(corpus.translate(_sentence_tokens(spark, d), ad.lexicon(spark, d), keep_unknown=True))


@query(f"""WITH {_TRANS}, l AS (SELECT DISTINCT lang FROM lexicon), m AS (SELECT en.doc_id || ':' || en.line_no AS sentence, token, coalesce(artificial, CASE WHEN regexp_full_match(token, '[.,]') THEN token END) AS mapped FROM en CROSS JOIN l LEFT JOIN lexicon x ON x.lang = l.lang AND x.key = en.token),
s AS (SELECT sentence, bool_and(mapped IS NOT NULL) AS ok FROM m GROUP BY sentence), mi AS (SELECT DISTINCT token FROM m WHERE mapped IS NULL)
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS skipped, round(count(*) FILTER (WHERE ok) / count(*), 6) AS share, (SELECT count(*) FROM mi) AS missing, (SELECT list(token ORDER BY token) FROM (SELECT token FROM mi ORDER BY token LIMIT 50)) AS sample FROM s""")
def missing_tokens(spark, d):
    m = corpus.translate(_sentence_tokens(spark, d), ad.lexicon(spark, d), keep_unknown=False)
    return corpus.corpus_counts(corpus.sentences(m), m)


@query(f"""WITH RECURSIVE {_ANCHOR}, {ad.LEXICON}, anchors AS (SELECT token AS key FROM fold WHERE token IS NOT NULL), back AS (SELECT artificial, key FROM lexicon SEMI JOIN anchors USING (key)),
tr AS (SELECT doc_id, line_no, pos - 1 AS pos, artificial FROM toks JOIN lexicon ON lexicon.lang = 'a' AND key = token)
SELECT doc_id, line_no, CAST(pos AS INTEGER) AS pos, coalesce(key, tr.artificial) AS token FROM tr LEFT JOIN back ON back.artificial = tr.artificial""")
def anchor_overwrite(spark, d):
    lex = ad.lexicon(spark, d)
    own = _line_tokens(spark, d).drop("lang").join(lex.where("lang = 'a'").select(F.col("key").alias("token"), "artificial"), "token")
    anchors = corpus.select_anchors(_frequency(spark, d), "mid", 0.05, 1)
    return corpus.overwrite(own.select("doc_id", "line_no", "pos", F.col("artificial").alias("token")), anchors, lex).select("doc_id", "line_no", "pos", "token")


_CONV = "a AS (SELECT conv_id, role, turn AS ordinal, text FROM conversations WHERE turn % 2 = 0), b AS (SELECT conv_id, role, turn AS ordinal, text FROM conversations WHERE turn % 2 = 1)"


@query(f"WITH {_CONV}, x AS (SELECT conv_id, arg_max(text, ordinal) AS lang_a FROM a GROUP BY conv_id), y AS (SELECT conv_id, arg_max(text, ordinal) AS lang_b FROM b GROUP BY conv_id) SELECT conv_id, md5(lang_a) AS a, md5(lang_b) AS b FROM x JOIN y USING (conv_id)")
def parallel_join(spark, d):
    c = ad.table(spark, d, "conversations").withColumn("ordinal", F.col("turn"))
    return corpus.join_shared(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"), ["conv_id"]).select("conv_id", F.md5("lang_a").alias("a"), F.md5("lang_b").alias("b"))


@query(f"WITH {ad.LINES}, a AS (SELECT *, doc_id // 2 AS pair FROM lines WHERE doc_id % 2 = 0), b AS (SELECT *, doc_id // 2 AS pair FROM lines WHERE doc_id % 2 = 1) SELECT pair, line_no, md5(a.text) AS lang_a, md5(b.text) AS lang_b FROM a JOIN b USING (pair, line_no)")
def parallel_zip_by_line(spark, d):
    lines = ad.corpus_lines(spark, d).withColumn("pair", F.floor(F.col("doc_id") / 2))
    both = corpus.zip_lines(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1"), ["pair"])
    return both.select("pair", "line_no", F.md5("lang_a").alias("lang_a"), F.md5("lang_b").alias("lang_b"))


@query(f"WITH {LINE_TOKENS}, t AS (SELECT DISTINCT token FROM toks) SELECT token, CAST(row_number() OVER (ORDER BY encode(token)) + 4 AS INTEGER) AS id FROM t UNION ALL SELECT s, CAST(i - 1 AS INTEGER) FROM (SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]']) AS s, generate_subscripts(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]'], 1) AS i)")
def fixed_vocabulary(spark, d):
    return corpus.vocabulary(_line_tokens(spark, d), ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"])


@query(f"WITH {_FREQ} SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id FROM freq WHERE n >= 2 UNION ALL SELECT '[PAD]', 0 UNION ALL SELECT '[UNK]', 1")
def trained_vocabulary(spark, d):
    return corpus.trained_vocabulary(_frequency(spark, d), ["[PAD]", "[UNK]"], 2)


@query(f"WITH {KG}, {ad.LEXICON.replace('lexicon AS', 'lx AS')}, lex AS (SELECT DISTINCT key FROM lx UNION SELECT DISTINCT source FROM kg WHERE relation = 'hasBrand'), ends AS (SELECT source AS node FROM kg UNION SELECT target FROM kg) SELECT key, ['N'] AS pos, 'grammar' AS source FROM lex UNION ALL SELECT node, [CASE WHEN starts_with(node, 'a_') THEN 'ADJ' ELSE 'N' END], 'edge_endpoint_augmented' FROM ends WHERE node NOT IN (SELECT key FROM lex)")
def lexicon_augment_missing(spark, d):
    from glossweave.operators.graph import endpoints

    e = ad.kg_edges(spark, d)
    keys = ad.lexicon(spark, d).select("key").union(e.where("relation = 'hasBrand'").select("source")).distinct()
    lex = keys.select("key", F.array(F.lit("N")).alias("pos"), F.lit("grammar").alias("source"))
    return lexicon.augmented(lex, endpoints(e))


@query(f"WITH {ad.LEXICON}, u AS (SELECT artificial AS token, 0 AS side, key AS ordinal FROM lexicon WHERE lang = 'a' UNION ALL SELECT artificial, 1, key FROM lexicon WHERE lang = 'b') SELECT token, CAST(row_number() OVER (ORDER BY side, ordinal, token) AS INTEGER) AS place FROM (SELECT token, min(side) AS side, arg_min(ordinal, side) AS ordinal FROM u GROUP BY token)")
def union_tokens(spark, d):
    lex = ad.lexicon(spark, d)
    side = lambda x: lex.where(F.col("lang") == x).select(F.col("artificial").alias("token"), F.col("key").alias("ordinal"))
    return lexicon.union_tokens(side("a"), side("b"))


@query()
def artificial_tokens(spark, d):
    return lexicon.artificial_tokens(ad.lexicon(spark, d).where("lang = 'a'").select("key"), "hiragana", 42)


@query(rf"WITH {LINE_TOKENS} SELECT doc_id, line_no, md5('<' || lang || '> ' || string_agg(CASE WHEN token IN ('.', ',', ';') THEN token || '_' || lang ELSE token END, ' ' ORDER BY pos) || CASE lang WHEN 'en' THEN ' </en>' ELSE ' </s>' END) AS digest FROM toks GROUP BY doc_id, line_no, lang")
def structural_tokens(spark, d):
    own = ad.corpus_lines(spark, d).withColumn("w", probing.punctuated(tx.words(F.col("text")), F.col("lang"), "disjoint")).where(F.size("w") > 0)
    return own.select("doc_id", "line_no", F.md5(F.array_join(probing.wrapped(F.col("w"), F.col("lang"), {"en": ("<en>", "</en>"), "fr": ("<fr>", "</s>"), "de": ("<de>", "</s>"), "es": ("<es>", "</s>")}), " ")).alias("digest"))


_LOG = "'Test 1\nEvaluated ' || n || ' word pairs\ntop-1 precision : 0.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') || '00 (x)\ntop-5 precision : 0.8000\nTest 2\nover ' || (n * 2) || ' sentences\ntop-1 precision : 0.6500\ntop-5 precision : 0.9000\n'"


@query(f"WITH c AS (SELECT n_nationkey AS k, n_nationkey + 100 AS n FROM nation), t AS (SELECT k, n, {_LOG} AS log FROM c) SELECT k, CAST(n AS INTEGER) AS pairs, CAST(n * 2 AS INTEGER) AS sentences, (n % 100) / 100.0 AS word_top1, 0.8::DOUBLE AS word_top5, 0.65::DOUBLE AS sent_top1, 0.9::DOUBLE AS sent_top5, 0.65::DOUBLE AS section_sent_top1, '0.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') || '00 +/- 0.1000' AS shown FROM t")
def log_metrics_parse(spark, d):
    n = (F.col("n_nationkey") + 100).cast("string")
    share = F.lpad((F.col("n_nationkey") % 100).cast("string"), 2, "0")
    log = F.concat(F.lit("Test 1\nEvaluated "), n, F.lit(" word pairs\ntop-1 precision : 0."), share, F.lit("00 (x)\ntop-5 precision : 0.8000\nTest 2\nover "), ((F.col("n_nationkey") + 100) * 2).cast("string"), F.lit(" sentences\ntop-1 precision : 0.6500\ntop-5 precision : 0.9000\n"))
    own = ad.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), log.alias("log"))
    return own.select("k", report.word_log(F.col("log")).alias("m"), report.section_precision(F.col("log"), "Test 2", 1).alias("section_sent_top1")).select("k", "m.*", "section_sent_top1", tx.mean_pm_sd(F.col("m.word_top1"), F.lit(0.1)).alias("shown"))
