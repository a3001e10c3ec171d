"""One query per operator over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biospark.llm import (
    bpe, collocations, conversations, exact, langid, license, linededup, mixing, quality, simhash, substrings, tokenbin, toxicity,
)
from biospark.llm.words import GAP_CLASS, WORD, WORD_CLASS, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, reach=2)
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.license_scan(documents(spark, sf_dir))
    return found.select("doc_id", "start", "end", "license", F.round("dice", 9).alias("dice"), "part")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).drop("clean_text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.predict(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_report(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.deduplicate_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_deleted", F.sha2("clean_text", 256).alias("clean_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(documents(spark, sf_dir))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(documents(spark, sf_dir))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_report(rows, conversations.damage(rows))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_license_scan,
        op3_quality_rules,
        op4_language_id,
        op5_toxicity,
        op6_token_binary,
        op7_line_dedup,
        op8_source_mix,
        op9_exact_dedup,
        op10_bpe_round_trip,
        op11_collocations,
        op12_conversation_repair,
        op13_substring_dedup,
    )
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _fails(line: str) -> str:
    rules = (*quality.PUNCTUATION_RULES, *quality.NAVIGATION_RULES, *quality.BOILERPLATE_RULES)
    matches = " OR ".join(f"regexp_matches({line}, {_quoted(r)})" for r in rules)
    unfinished = " AND ".join(
        f"NOT regexp_matches({line}, {_quoted(r)})" for r in (quality.ENDS_SENTENCE, quality.LONG_LINE)
    )
    return f"({unfinished}) OR {matches}"


def _more(prefix: str, cost: int | str, letter: str) -> str:
    """A prefix of edits, written as its cost in six digits and its letters, with one more; null stays null."""
    return f"(lpad(({prefix}[1:6]::INTEGER + {cost})::VARCHAR, 6, '0') || {prefix}[7:] || '{letter}')"


_INSERTED = {
    "u1": f"least(u, {_more('n', 5, 'I')}, {_more('s', 5, 'I')}, {_more('a', 5, 'I')})",
    "a1": f"least(a, {_more('u', 5, 'I')}, {_more(_more('n', 5, 'I'), 5, 'I')}, {_more(_more('s', 5, 'I'), 5, 'I')})",
}


def _kept_as(initial: str, prefix: str) -> str:
    return f"CASE WHEN gone = 0 AND left(role, 1) = '{initial}' THEN {_more(prefix, 'extra', 'K')} END"


def _changed(prefix: str) -> str:
    return f"CASE WHEN gone = 0 THEN {_more(prefix, '1 + extra', 'R')} END"


_CRC32 = """xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
            lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


ORACLE: dict[str, str] = {
    "op3_quality_rules": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, {_quoted(WORD)}) AS words,
                [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, {_quoted(WORD_CLASS)})] AS lines FROM d),
        g AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram
              FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
        t AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
        c AS (SELECT r, count(DISTINCT p) AS covered FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM t) GROUP BY r),
        m AS (SELECT doc_id, len(words) AS n_words,
                length(regexp_replace(text, {_quoted(GAP_CLASS)}, '', 'g')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                coalesce(covered, 0) AS n_repeat_words,
                len(regexp_extract_all(array_to_string([x FOR x IN lines IF NOT ({_fails("x")})], chr(10)), {_quoted(WORD)}))
                  AS n_kept_words
              FROM w LEFT JOIN c USING (r)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT *, NOT base_failed AND n_words - n_kept_words <= 0.5 * n_words AS kept FROM b""",
    "op7_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        a AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM d),
        l AS (SELECT *, len(regexp_extract_all(line, {_quoted(WORD)})) AS w FROM a WHERE regexp_matches(line, {_quoted(WORD_CLASS)})),
        s AS (SELECT *, sum(w) OVER (PARTITION BY r ORDER BY pos) - w AS start FROM l),
        n AS (SELECT x.doc_id, x.r, x.pos, list(y.line ORDER BY y.pos) AS content, list(y.pos ORDER BY y.pos) AS places
              FROM s x JOIN s y ON x.r = y.r AND y.start BETWEEN x.start AND x.start + {linededup.MIN_WORDS - 1}
              GROUP BY x.r, x.doc_id, x.pos, x.start HAVING max(y.start + y.w) >= x.start + {linededup.MIN_WORDS}
              UNION ALL
              SELECT x.doc_id, x.r, x.pos, list(y.line ORDER BY y.pos), list(y.pos ORDER BY y.pos)
              FROM s x JOIN s y ON x.r = y.r
                AND y.start + y.w BETWEEN x.start + x.w - {linededup.MIN_WORDS - 1} AND x.start + x.w
              GROUP BY x.r, x.doc_id, x.pos, x.start, x.w HAVING x.start + x.w - min(y.start) >= {linededup.MIN_WORDS}),
        c AS (SELECT r, places, (doc_id, places[1]) > min((doc_id, places[1])) OVER (PARTITION BY content) AS later FROM n),
        g AS (SELECT DISTINCT r, unnest(places) AS pos FROM c WHERE later)
        SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY a.pos) FILTER (g.pos IS NULL), '')) AS clean_sha256
        FROM a LEFT JOIN g ON a.r = g.r AND a.pos = g.pos GROUP BY a.r, doc_id""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
        g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS a
              FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
                    FROM w, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS m)) GROUP BY ALL),
        t AS (SELECT lang, sum(a) AS n FROM g WHERE m = 1 GROUP BY lang),
        f AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE m > 1 AND a >= {collocations.LEAST}),
        i AS (SELECT lang, array_to_string(ws[j:j + s - 1], ' ') AS phrase, max(a) AS around
              FROM (SELECT *, unnest(range(1, m - s + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS s FROM f)) GROUP BY ALL),
        c AS (SELECT f.*, unnest(range(1, m)) AS k FROM f LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR around < f.a),
        z AS (SELECT c.lang, c.phrase, c.a, k, h.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (h.a::HUGEINT * r.a) AS score
              FROM c JOIN g h ON h.lang = c.lang AND h.phrase = array_to_string(ws[:k], ' ')
                JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ') JOIN t ON t.lang = c.lang),
        b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= {collocations.TOP}""",
    "op12_conversation_repair": f"""
        WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        x AS (SELECT *, {_CRC32} % 20 AS chance FROM o),
        d AS (SELECT conv_id, turn, CASE WHEN chance = 4 THEN 'user' ELSE role END AS role,
                CASE chance WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN chance = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE chance <> 0),
        q AS (SELECT *, row_number() OVER c AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
                lag(left(role, 1)) OVER c AS before
              FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, {_quoted(WORD_CLASS)}) THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?]{GAP_CLASS}*$') THEN 'truncated' ELSE 'none' END AS fault FROM q),
        m AS (SELECT *, (fault IN ('blank', 'duplicate'))::INTEGER AS gone, 5 * (fault = 'truncated')::INTEGER AS extra FROM f),
        v AS (SELECT conv_id, 0::BIGINT AS pos, '000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a
              FROM (SELECT DISTINCT conv_id FROM m)
              UNION ALL
              SELECT conv_id, pos, {_more("n", 2, "D")},
                least({_more("s", 2, "D")}, {_kept_as("s", "n")}),
                least({_more("u1", 2, "D")}, {_kept_as("u", "b")}, {_changed("b")}),
                least({_more("a1", 2, "D")}, {_kept_as("a", "u1")}, {_changed("u1")})
              FROM (SELECT m.conv_id, m.pos, role, gone, extra, n, s, {_INSERTED["u1"]} AS u1, {_INSERTED["a1"]} AS a1, least(n, s, a1) AS b
                    FROM v JOIN m ON m.conv_id IS NOT DISTINCT FROM v.conv_id AND m.pos = v.pos + 1)),
        e AS (SELECT conv_id, least(n, a, {_more("u", 5, "I")}, {_more(_more("s", 5, "I"), 5, "I")}) AS best
              FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
        l AS (SELECT conv_id, place, letter, sum((letter <> 'I')::INTEGER) OVER w AS pos, sum((letter <> 'D')::INTEGER) OVER w AS given
              FROM (SELECT conv_id, unnest(string_split(best[7:], '')) AS letter, generate_subscripts(string_split(best[7:], ''), 1) AS place FROM e)
              WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
        y AS (SELECT l.*, m.role AS old_role, m.text AS old_text,
                bool_or(letter = 'K' AND left(m.role, 1) = 's') OVER (PARTITION BY l.conv_id) AS system
              FROM l LEFT JOIN m ON letter <> 'I' AND m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.pos = l.pos),
        z AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN old_role WHEN given % 2 = system::INTEGER THEN 'assistant' ELSE 'user' END
                || ':' || coalesce(old_text, ''), chr(10) ORDER BY place) FILTER (letter <> 'D')) AS sha FROM y GROUP BY conv_id),
        r AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best[1:6]::BIGINT, 0) AS cost,
               coalesce(best[7:], '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
          LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM i.conv_id""",
    "op13_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_quoted(WORD)}) AS ws FROM documents),
        w AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS size FROM d),
        a AS (SELECT *, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i
                ROWS BETWEEN CURRENT ROW AND {substrings.MIN_WORDS - 1} FOLLOWING)) AS content FROM w),
        h AS (SELECT *, i + {substrings.MIN_WORDS - 1} <= size AND doc_id > min(doc_id) FILTER (i + {substrings.MIN_WORDS - 1} <= size)
                OVER (PARTITION BY content) AS hit FROM a),
        c AS (SELECT r, i, word, coalesce(bool_or(hit) OVER (PARTITION BY r ORDER BY i
                ROWS BETWEEN {substrings.MIN_WORDS - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM h),
        s AS (SELECT r, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)""",
}
