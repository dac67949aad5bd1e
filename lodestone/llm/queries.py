"""The registered queries of the operators, each with its SQL where one exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import alignment, bpe, decontaminate, exact_dedup, filter_audit, id_files, jaccard_join, language_id, license_scan, mixing, quality, substring_dedup, url_filter
from lodestone.llm.tables import ORACLE, QUERIES, registered, stored, table, texts  # noqa: F401
from lodestone.session import scratch_path


@registered()
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and their decoded bytes, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = texts(table(spark, folder, "documents"))
    return bpe.digests(bpe.round_trip(docs, path, public_tokenizers.PATTERN))


@registered()
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document written to files and read back."""
    docs = texts(table(spark, folder, "documents"))
    path = public_tokenizers.path("word_bpe_49k.json")
    found = id_files.write_texts(docs, path, 1, scratch_path(spark, "token-files"))
    return found.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@registered(
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays for it."""
    found = exact_dedup.exact_duplicates(texts(table(spark, folder, "documents")))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@registered()
def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that occur in several documents."""
    return substring_dedup.repeated_passages(texts(table(spark, folder, "documents")))


@registered()
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, language_id.train(docs))


def _spaced(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


@registered(
    rf"""
    WITH w AS (SELECT rowid_, doc_id, coalesce(text, '') AS text, {_spaced('text')} AS w,
                      [x FOR x IN string_split(coalesce(text, ''), chr(10))
                       IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
               FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
    win AS (SELECT rowid_, i, array_to_string(w[i:i + 7], ' ') AS h
            FROM (SELECT rowid_, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
    again AS (SELECT rowid_, i FROM win QUALIFY count(*) OVER (PARTITION BY rowid_, h) > 1),
    cov AS (SELECT rowid_, count(DISTINCT i + k) AS n FROM again, range(8) AS r(k) GROUP BY rowid_),
    fig AS (SELECT w.rowid_, doc_id, text, len(w)::BIGINT AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                   coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN cov USING (rowid_)),
    base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM fig)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words
                OR 5 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines
                OR 2 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < word_chars) AS kept
    FROM base
    """
)
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality figures of every document and whether it is kept."""
    found = quality.judge(texts(table(spark, folder, "documents")))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The rules of the URL query: verdict and host with path.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def _url_sql() -> str:
    rules = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in URL_RULES)
    unit, start = url_filter.UNIT, url_filter.UNIT * (100 - url_filter.WALKS) // 100
    steps = []
    for name, seeds, source, target in (("t", "allowed", "src", "dst"), ("d", "(n - allowed)", "dst", "src")):
        steps.append(f"{name}s AS (SELECT host, {start}::BIGINT * {seeds} // n AS score FROM seeds WHERE {seeds} > 0)")
        steps.append(
            f"{name}e AS (SELECT src, dst, count(*) OVER (PARTITION BY {source}) AS degree FROM links)"
        )
        steps.append(f"{name}0 AS (SELECT * FROM {name}s)")
        for k in range(1, url_filter.ROUNDS + 1):
            steps.append(
                f"{name}{k} AS (SELECT host, sum(score)::BIGINT AS score FROM (SELECT * FROM {name}s UNION ALL "
                f"SELECT e.{target}, s.score // e.degree * {url_filter.WALKS} // 100 FROM {name}{k - 1} s "
                f"JOIN {name}e e ON s.host = e.{source}) GROUP BY host)"
            )
    last = url_filter.ROUNDS
    host, path = "^.*?://([^/?#]*)", "^.*?://[^/?#]*([^?#]*)"
    lower = f"'{url_filter.UPPER}', '{url_filter.UPPER.lower()}'"
    return f"""
    WITH rules AS (SELECT verdict, rule, regexp_extract(rule, '^[^/]*') AS rule_host,
                          regexp_extract(rule, '^[^/]*(.*)$', 1) AS rule_path
                   FROM (VALUES {rules}) AS v(verdict, rule)),
    own AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{host}', 1, 's'), {lower}) AS host,
                   regexp_extract(coalesce(url, ''), '{path}', 1, 's') AS path FROM pages),
    fit AS (SELECT o.page_id, o.host, o.path, r.rule, r.verdict FROM own o LEFT JOIN rules r
              ON (o.host = r.rule_host OR ends_with(o.host, '.' || r.rule_host)) AND starts_with(o.path, r.rule_path)
            QUALIFY row_number() OVER (PARTITION BY o.page_id ORDER BY length(r.rule) DESC NULLS LAST) = 1),
    seeds AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow') AS allowed, count(*) AS n
              FROM fit WHERE rule IS NOT NULL GROUP BY host),
    found AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{url_filter.LINK.replace("'", "''")}', 1)) AS link
              FROM own),
    links AS (SELECT DISTINCT src, dst FROM (
                SELECT src, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END,
                                                     '{host}', 1, 's'), {lower}) AS dst FROM found)
              WHERE src <> '' AND dst <> '' AND src <> dst),
    {", ".join(steps)}
    SELECT f.page_id, f.host, f.path, f.rule,
           CASE WHEN f.rule IS NOT NULL THEN f.verdict
                WHEN coalesce(d.score, 0) > coalesce(t.score, 0) AND coalesce(d.score, 0) >= {unit // 50} THEN 'block'
                ELSE 'allow' END AS verdict
    FROM fit f LEFT JOIN t{last} t ON t.host = f.host LEFT JOIN d{last} d ON d.host = f.host
    """


@registered(_url_sql())
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page by rules and by trust over links."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


def _license_sql() -> str:
    def tidy(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), '{license_scan.COPYRIGHT_LINE}', '\\1', 'g')"
        for spelling, used in license_scan.SPELLINGS:
            out = f"replace({out}, '{spelling}', '{used}')"
        return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    def canonical(unit: str) -> str:
        return f"trim(regexp_replace({unit}, '[ \\n]+', ' ', 'g'))"

    known = ", ".join(f"('{name}', '{text}')" for name, text in license_scan.KNOWN)
    return f"""
    WITH known AS (SELECT DISTINCT license_id, sha256({canonical(tidy('text'))}) AS digest
                   FROM (VALUES {known}) AS v(license_id, text)),
    own AS (SELECT doc_id, row_number() OVER () AS row_, {tidy('text')} AS t FROM documents),
    units AS (SELECT doc_id, row_, t AS u, 0 AS kind FROM own
              UNION ALL SELECT doc_id, row_, unnest(regexp_split_to_array(t, '\\n *\\n')), 1 FROM own
              UNION ALL SELECT doc_id, row_, unnest(string_split(t, chr(10))), 2 FROM own),
    hits AS (SELECT doc_id, row_, kind, license_id
             FROM (SELECT doc_id, row_, kind, {canonical('u')} AS form FROM units) x
             JOIN known ON sha256(form) = digest WHERE form <> '')
    SELECT any_value(doc_id) AS doc_id, license_id,
           CASE min(kind) WHEN 0 THEN 'text' WHEN 1 THEN 'paragraph' ELSE 'line' END AS unit,
           greatest(count(*) FILTER (WHERE kind = 2), 1) AS matches
    FROM hits GROUP BY row_, license_id
    """


@registered(_license_sql())
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence texts and notices in every document."""
    docs = texts(table(spark, folder, "documents"))
    return license_scan.scan(docs, license_scan.known_digests(spark, [*license_scan.KNOWN, *license_scan.whole_texts()]))


@registered(
    r"""
    WITH own AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                        md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, '-'), md5(coalesce(text, '')))) AS mark
                 FROM documents),
    src AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
                   row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM own GROUP BY source),
    wei AS (SELECT *, [3, 1, 2][(sid - 1) % 3 + 1] AS weight, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS want FROM src),
    ful AS (SELECT *, (want - coalesce(sum(cap) OVER (fullest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
                      / (sum(weight) OVER (fullest ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT
                      >= cap::DOUBLE / weight AS is_full
            FROM wei WINDOW fullest AS (ORDER BY cap::DOUBLE / weight, sid)),
    tar AS (SELECT *, CASE WHEN is_full THEN cap::DOUBLE
                           ELSE (want - (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::BIGINT) * weight
                                / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::BIGINT END AS target FROM ful),
    cum AS (SELECT o.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
                   coalesce(sum(size) OVER (PARTITION BY sid ORDER BY mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM own o JOIN tar t ON o.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           passes * size + greatest(least(round(target - passes * source_size)::BIGINT - before, size), 0) AS taken
    FROM cum
    """
)
def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.taken_words(docs).drop("shards")


@registered()
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The component of near duplicates of every document."""
    found = jaccard_join.near_duplicates(texts(table(spark, folder, "documents")), 4, 85)
    return found.select("doc_id", "n_shingles", "component_id")


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@registered(
    f"""
    WITH own AS (SELECT row_number() OVER () AS row_, doc_id, {_ITEM_WORDS.format("text")} AS w FROM documents),
    item AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS size
             FROM (SELECT item_id, {_ITEM_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
    known AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS form
              FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM item)),
    lengths AS (SELECT DISTINCT size FROM known),
    win AS (SELECT row_, size, i, array_to_string(w[i:i + size - 1], ' ') AS form
            FROM (SELECT row_, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM own, lengths)),
    hit AS (SELECT row_, i, win.size, item_id FROM win JOIN known USING (size, form)),
    cov AS (SELECT row_, count(DISTINCT i + k) AS n FROM hit, range({decontaminate.WINDOW}) AS r(k) WHERE k < size GROUP BY row_),
    its AS (SELECT row_, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT row_, item_id::VARCHAR AS id FROM hit) GROUP BY row_)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
           sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
    FROM own LEFT JOIN cov USING (row_) LEFT JOIN its USING (row_)
    """
)
def op12_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie inside windows of test items, and the items."""
    items = table(spark, folder, "benchmark").select("item_id", "text")
    found = decontaminate.scan(texts(table(spark, folder, "documents")), items)
    ids = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@registered(
    r"""
    WITH own AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                        regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    fails AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
                     [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
                      regexp_matches(text, '[#$%&*|]'),
                      coalesce(o.doc_id > min(o.doc_id) OVER (PARTITION BY text), false)] AS f
              FROM own o LEFT JOIN marks m ON o.doc_id = m.doc_id),
    classes AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
    letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
               FROM letter a, letter b, letter c, letter d, letter e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT filter_order, step, strpos('ABCDE', filter_order[step]) AS own,
                     [strpos('ABCDE', filter_order[j]) FOR j IN range(1, step)] AS earlier
              FROM orders, (SELECT unnest(range(1, 6)) AS step)),
    per AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails,
                   len([j FOR j IN earlier IF f[j]]) > 0 AS gone,
                   f[own] AND len([x FOR x IN f IF x]) = 1 AS alone
            FROM classes, steps),
    counts AS (SELECT part, filter_order, step, own,
                      coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept,
                      coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
                      coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant,
                      coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails,
                      coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS good_lost,
                      coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS toxic_lost
               FROM per GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM counts
    """
)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from every source at every place of every order."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, folder, "labels").select("doc_id", "quality", "toxic"))


@registered()
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers over every document, and how common its links are in the corpus."""
    path_a, path_b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align(texts(table(spark, folder, "documents")), path_a, path_b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = stored(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    weighed = alignment.weigh(found, alignment.pair_counts(found))
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
