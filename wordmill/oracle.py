"""Independent SQL statements of each registered query, runnable by DuckDB on the same
parquet tables (views ``documents``, ``labels``, ``embeddings`` ...).

The SQL restates each rule directly; it shares only the fixed values (whitespace class,
patterns, reserved tokens) with the Spark code. Output conventions: integers as BIGINT,
doubles rounded to 6 places, arrays as space-joined strings.
"""

from __future__ import annotations

from wordmill.functions.text import CJK_CLASS, NUMBER_PATTERN, SYMBOL_CLASS, WS_CLASS

ORACLE: dict[str, str] = {}

WS = WS_CLASS
SYM = SYMBOL_CLASS.replace("'", "''")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


LINES = """lines AS (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no,
         unnest(parts) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""

WTOK = f"""wtok AS (
  SELECT doc_id, line_no, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, line_no,
               list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS t
        FROM lines))"""

CTOK = f"""ctok AS (
  SELECT doc_id, line_no, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, line_no,
               list_filter(string_split(regexp_replace(text, '{WS}', '', 'g'), ''),
                           lambda x: x <> '') AS t
        FROM lines))"""


WCOUNTS = f"""wcounts AS (
  SELECT token, count(*) AS freq, min({{'d': doc_id, 'l': line_no, 'p': pos}}) AS f
  FROM wtok GROUP BY token)"""
CCOUNTS = f"""ccounts AS (
  SELECT token, count(*) AS freq, min({{'d': doc_id, 'l': line_no, 'p': pos}}) AS f
  FROM ctok GROUP BY token)"""


def _vocab(name: str, counts: str, k: int = 20) -> str:
    return f"""{name} AS (
  SELECT CAST(0 AS BIGINT) AS id, 'UNK' AS token
  UNION ALL
  SELECT CAST(row_number() OVER (ORDER BY freq DESC, f.d, f.l, f.p) AS BIGINT) AS id, token
  FROM {counts}
  WHERE freq >= {k} AND token NOT IN ('UNK', '_start_', '_delimiter_', '_end_'))"""


WVOCAB = _vocab("wvocab", "wcounts")
CVOCAB = _vocab("cvocab", "ccounts")
NV = "(SELECT count(*) FROM wvocab)"
SPECIALS = f"""wspecials AS (
  SELECT id, token FROM wvocab
  UNION ALL SELECT {NV}, '_start_'
  UNION ALL SELECT {NV} + 1, '_delimiter_'
  UNION ALL SELECT {NV} + 2, '_end_')"""

RATE = "(SELECT least(10000.0::DOUBLE / count(*), 0.1) FROM lines)"
HASH_UNIT = ("(('0x' || substr(md5(concat_ws(':', '42', doc_id, line_no)), 1, 8))::BIGINT "
             "/ 4294967296.0)")

WUNK = f"""wunk AS (
  SELECT l.doc_id, l.line_no, coalesce(r.text, '') AS text
  FROM lines l LEFT JOIN (
    SELECT t.doc_id, t.line_no,
           string_agg(CASE WHEN v.id IS NULL THEN 'UNK' ELSE t.token END, ' ' ORDER BY t.pos) AS text
    FROM wtok t LEFT JOIN wvocab v ON v.token = t.token AND v.id > 0
    GROUP BY t.doc_id, t.line_no) r
  ON l.doc_id = r.doc_id AND l.line_no = r.line_no)"""

CUNK = f"""cchars AS (
  SELECT doc_id, line_no, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS ch
  FROM (SELECT doc_id, line_no,
               string_split(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '') AS t
        FROM lines)),
cunk AS (
  SELECT l.doc_id, l.line_no, coalesce(r.text, '') AS text
  FROM lines l LEFT JOIN (
    SELECT t.doc_id, t.line_no,
           string_agg(CASE WHEN t.ch = '' OR regexp_full_match(t.ch, '{WS}') THEN ''
                           WHEN v.id IS NULL THEN 'UNK' ELSE t.ch END, ' ' ORDER BY t.pos) AS text
    FROM cchars t LEFT JOIN cvocab v ON v.token = t.ch AND v.id > 0
    GROUP BY t.doc_id, t.line_no) r
  ON l.doc_id = r.doc_id AND l.line_no = r.line_no)"""

WCORPUS = f"""wcorpus AS (
  SELECT u.doc_id, u.line_no,
         CASE WHEN {HASH_UNIT} < {RATE} THEN 'dev' ELSE 'train' END AS split, u.text
  FROM wunk u)"""

# token ids of every line of the word corpus (single-space split, unknown -> 0)
WENC = f"""wenc_tok AS (
  SELECT doc_id, line_no, split, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos,
         unnest(t) AS token
  FROM (SELECT doc_id, line_no, split, string_split(text, ' ') AS t FROM wcorpus)),
wenc AS (
  SELECT e.doc_id, e.line_no, e.split,
         list(coalesce(s.id, 0) ORDER BY e.pos) AS ids
  FROM wenc_tok e LEFT JOIN wspecials s ON s.token = e.token
  GROUP BY e.doc_id, e.line_no, e.split)"""

WFRAMED = f"""wframed AS (
  SELECT doc_id, line_no,
         list_concat([{NV}], ids[1:{200 - 2}], [{NV} + 2]) AS ids
  FROM wenc WHERE split = 'train')"""

ALL_W = [LINES, WTOK, WCOUNTS, WVOCAB]


ORACLE["corpus_lines"] = _with(LINES) + "SELECT doc_id, line_no, text FROM lines"

ORACLE["word_tokens"] = _with(LINES) + f"""
SELECT doc_id, line_no, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, line_no,
             list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS t FROM lines)"""

ORACLE["char_tokens"] = _with(LINES) + f"""
SELECT doc_id, line_no, CAST(len(t) AS BIGINT) AS n_chars, array_to_string(t, ' ') AS chars
FROM (SELECT doc_id, line_no,
             list_filter(string_split(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), ''),
                         lambda x: x <> ' ' AND x <> '') AS t FROM lines)"""

ORACLE["strip_text"] = _with(LINES) + f"""
SELECT doc_id, line_no, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text FROM lines"""

ORACLE["token_counts_word"] = _with(LINES, WTOK, WCOUNTS) + """
SELECT token, freq, f.d AS first_doc_id, f.l AS first_line_no, f.p AS first_pos FROM wcounts"""

ORACLE["token_counts_char"] = _with(LINES, CTOK, CCOUNTS) + """
SELECT token, freq, f.d AS first_doc_id, f.l AS first_line_no, f.p AS first_pos FROM ccounts"""

ORACLE["corpus_totals"] = _with(LINES, WTOK) + f"""
SELECT (SELECT count(*) FROM lines) AS n_lines,
       (SELECT count(*) FROM wtok) AS n_tokens,
       (SELECT count(DISTINCT token) FROM wtok) AS n_distinct,
       (SELECT CAST(coalesce(sum(len(list_filter(string_split(
            regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), ''),
            lambda x: x <> ' ' AND x <> ''))), 0) AS BIGINT) FROM lines) AS n_chars"""

ORACLE["min_count"] = _with(LINES, WTOK, WCOUNTS) + \
    "SELECT token, freq FROM wcounts WHERE freq >= 20"

ORACLE["vocab_word"] = _with(*ALL_W) + "SELECT id, token FROM wvocab"

ORACLE["vocab_char"] = _with(LINES, CTOK, CCOUNTS, CVOCAB) + "SELECT id, token FROM cvocab"

ORACLE["vocab_specials"] = _with(*ALL_W, SPECIALS) + "SELECT id, token FROM wspecials"

ORACLE["counts_by_frequency"] = _with(LINES, WTOK, WCOUNTS) + """
SELECT CAST(row_number() OVER (ORDER BY freq DESC, f.d, f.l, f.p) - 1 AS BIGINT) AS rank,
       token, freq FROM wcounts"""

ORACLE["unk_replace_word"] = _with(*ALL_W, WUNK) + "SELECT doc_id, line_no, text FROM wunk"

ORACLE["unk_replace_char"] = _with(LINES, CTOK, CCOUNTS, CVOCAB, CUNK) + \
    "SELECT doc_id, line_no, text FROM cunk"

ORACLE["dev_rate"] = _with(LINES) + """
SELECT count(*) AS n_lines,
       round(CASE WHEN count(*) > 0 THEN least(10000.0::DOUBLE / count(*), 0.1) ELSE 0.0 END, 6)
         AS rate
FROM lines"""

ORACLE["dev_rate_by_chars"] = _with(LINES) + f"""
SELECT n AS n_chars, round(CASE WHEN n > 0 THEN 8000.0::DOUBLE / n ELSE 0.0 END, 6) AS rate
FROM (SELECT CAST(sum(len(list_filter(string_split(
            regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), ''),
            lambda x: x <> ' ' AND x <> ''))) AS BIGINT) AS n FROM lines)"""

ORACLE["random_split"] = _with(LINES) + f"""
SELECT doc_id, line_no, CASE WHEN {HASH_UNIT} < {RATE} THEN 'dev' ELSE 'train' END AS split
FROM lines"""

ORACLE["prepare_corpus"] = _with(*ALL_W, WUNK, WCORPUS) + \
    "SELECT doc_id, line_no, split, text FROM wcorpus"

ORACLE["prepare_corpus_char"] = _with(LINES, CTOK, CCOUNTS, CVOCAB, CUNK) + f"""
SELECT doc_id, line_no, CASE WHEN {HASH_UNIT} < {RATE} THEN 'dev' ELSE 'train' END AS split, text
FROM cunk"""

_ENC = [*ALL_W, WUNK, WCORPUS, SPECIALS, WENC]

ORACLE["encode"] = _with(*_ENC) + """
SELECT doc_id, line_no, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ' ') AS ids
FROM wenc"""

ORACLE["frame"] = _with(*_ENC, WFRAMED) + \
    "SELECT doc_id, line_no, array_to_string(ids, ' ') AS ids FROM wframed"

ORACLE["pad"] = _with(*_ENC, WFRAMED) + """
SELECT doc_id, line_no,
       array_to_string(list_concat(ids[1:200], list_transform(range(200 - len(ids[1:200])),
                                                             lambda x: 0)), ' ') AS padded
FROM wframed"""

ORACLE["length_mask"] = _with(*_ENC, WFRAMED) + """
SELECT doc_id, line_no, round(CAST(least(len(ids), 200) AS DOUBLE), 6) AS mask_sum,
       array_to_string(list_concat(list_transform(range(least(len(ids), 200)), lambda x: 1),
                                   list_transform(range(200 - least(len(ids), 200)),
                                                  lambda x: 0)), ' ') AS mask
FROM wframed"""

ORACLE["nonzero_mask"] = _with(*_ENC, WFRAMED) + """
SELECT doc_id, line_no, round(CAST(list_sum(m) AS DOUBLE), 6) AS mask_sum,
       array_to_string(m, ' ') AS mask
FROM (SELECT doc_id, line_no,
             list_transform(list_concat(ids[1:200],
                                        list_transform(range(200 - len(ids[1:200])), lambda x: 0)),
                            lambda x: sign(x)) AS m
      FROM wframed)"""

ORACLE["position_ids"] = _with(*_ENC, WFRAMED) + """
SELECT doc_id, line_no,
       array_to_string(list_transform(ids, lambda x, i: nv.v + 2 + i), ' ') AS pos_ids
FROM wframed, (SELECT count(*) AS v FROM wvocab) nv"""

ORACLE["end_position"] = _with(*_ENC, WFRAMED) + f"""
SELECT doc_id, line_no,
       CAST(greatest(coalesce(list_position(ids, {NV} + 2), 0) - 1, 0) AS BIGINT) AS end_pos
FROM wframed"""

ORACLE["sequence_length"] = _with(*_ENC, WFRAMED) + """
SELECT doc_id, line_no, CAST(least(len(ids), 200) AS BIGINT) AS len FROM wframed"""

WSEQ = """wseq AS (
  SELECT CAST(row_number() OVER (ORDER BY doc_id, line_no) - 1 AS BIGINT) AS row_idx,
         doc_id, line_no, ids
  FROM wframed)"""

ORACLE["row_index"] = _with(*_ENC, WFRAMED, WSEQ) + "SELECT doc_id, line_no, row_idx FROM wseq"

ORACLE["round_robin_shard"] = _with(*_ENC, WFRAMED, WSEQ) + """
SELECT CAST(row_idx % 10 AS BIGINT) AS shard, count(*) AS n_rows, min(row_idx) AS first_row
FROM wseq GROUP BY 1"""

ORACLE["prepare_sequences"] = _with(*_ENC, WFRAMED, WSEQ) + """
SELECT row_idx, CAST(row_idx % 10 AS BIGINT) AS shard, array_to_string(ids, ' ') AS ids FROM wseq"""

ORACLE["prepare_corpus_summary"] = _with(*ALL_W, WUNK, WCORPUS) + f"""
SELECT split, count(*) AS n_lines,
       CAST(sum(len(t)) AS BIGINT) AS n_tokens,
       CAST(sum(len(list_filter(t, lambda x: x = 'UNK'))) AS BIGINT) AS n_unk
FROM (SELECT split, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS t
      FROM wcorpus)
GROUP BY split"""


# ------------------------------------------------------------------ T5-T20
def _line_sql(expr: str) -> str:
    return _with(LINES) + f"SELECT doc_id, line_no, {expr} AS text FROM lines"


def _space_runs(x: str, cls: str) -> str:
    m = f"regexp_replace({x}, '({cls})', chr(57344) || '\\1' || chr(57345), 'g')"
    return f"translate(replace({m}, chr(57345) || chr(57344), ' '), chr(57344) || chr(57345), '  ')"


def _t(x): return f"regexp_replace({x}, '{NUMBER_PATTERN}', ' #num ', 'g')"
def _s(x): return f"regexp_replace({x}, '{NUMBER_PATTERN}', '*', 'g')"
def _ws(x): return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def _latin(x):
    marked = f"regexp_replace({x}, '([a-zA-Z]+)', ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g')"
    dropped = f"regexp_replace({marked}, ' ' || chr(1) || '[a-zA-Z]' || chr(2) || ' ', '', 'g')"
    return f"replace(replace({dropped}, chr(1), ''), chr(2), '')"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["mask_alnum"] = _line_sql("regexp_replace(text, '[a-z]+|[0-9]+|[A-Z]+', '*', 'g')")
ORACLE["collapse_stars"] = _line_sql("regexp_replace(text, '\\*+', '*', 'g')")
ORACLE["fix_typos"] = _line_sql(
    "replace(replace(translate(text, 'erth', '花贝借呗'), '花贝', '花呗'), '借贝', '借呗')")
ORACLE["tag_numbers"] = _line_sql(_t("text"))
ORACLE["star_numbers"] = _line_sql(_s("text"))
ORACLE["space_latin"] = _line_sql(_latin("text"))
ORACLE["lower_latin"] = _line_sql(
    f"translate(regexp_replace(text, '([a-zA-Z]+)', ' \\1 ', 'g'), '{UPPER}', '{LOWER}')")
ORACLE["space_symbols"] = _line_sql(_space_runs("text", SYM))
ORACLE["space_cjk"] = _line_sql(_space_runs("translate(text, 'the', '花呗贝')", CJK_CLASS))
ORACLE["collapse_ws"] = _line_sql(_ws("replace(text, ' ', ' ' || chr(9) || chr(12288))"))
ORACLE["clean_symbols"] = _line_sql(_ws(_space_runs(_s(_space_runs("text", SYM)), CJK_CLASS)))
ORACLE["clean_numbers"] = _line_sql(_ws(_latin(_t("text"))))

STOP = """stop AS (
  SELECT token FROM wcounts ORDER BY freq DESC, f.d, f.l, f.p LIMIT 20)"""

ORACLE["drop_stopwords"] = _with(LINES, WTOK, WCOUNTS, STOP) + """
SELECT l.doc_id, l.line_no, coalesce(r.n, 0) AS n_tokens, coalesce(r.tokens, '') AS tokens
FROM lines l LEFT JOIN (
  SELECT doc_id, line_no, count(*) AS n, string_agg(token, ' ' ORDER BY pos) AS tokens
  FROM wtok WHERE token NOT IN (SELECT token FROM stop) GROUP BY doc_id, line_no) r
ON l.doc_id = r.doc_id AND l.line_no = r.line_no"""

MASKED = """masked AS (
  SELECT doc_id, line_no,
         replace(replace(regexp_replace(regexp_replace(text, '[a-z]+|[0-9]+|[A-Z]+', '*', 'g'),
                                        '\\*+', '*', 'g'), '花贝', '花呗'), '借贝', '借呗') AS text
  FROM lines)"""
MTOK = WTOK.replace("wtok AS", "mtok AS").replace("FROM lines", "FROM masked")
MCOUNTS = WCOUNTS.replace("wcounts AS", "mcounts AS").replace("FROM wtok", "FROM mtok")

ORACLE["clean_words"] = _with(LINES, MASKED, MTOK, MCOUNTS) + """
SELECT l.doc_id, l.line_no, coalesce(r.text, '') AS text
FROM lines l LEFT JOIN (
  SELECT doc_id, line_no, string_agg(token, ' ' ORDER BY pos) AS text
  FROM mtok
  WHERE token NOT IN (SELECT token FROM mcounts ORDER BY freq DESC, f.d, f.l, f.p LIMIT 20)
  GROUP BY doc_id, line_no) r
ON l.doc_id = r.doc_id AND l.line_no = r.line_no"""

ORACLE["flatten_tokens"] = f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id,
             flatten(list_transform(string_split(text, chr(10)),
                     lambda l: list_filter(regexp_split_to_array(l, '{WS}+'),
                                           lambda x: x <> ''))) AS t
      FROM documents)"""

ORACLE["remove_none"] = _line_sql(
    "array_to_string(list_filter(list_transform(string_split(text, ' '), "
    "lambda x: nullif(x, '')), lambda x: x IS NOT NULL), ' ')")

# ------------------------------------------------------------------ W5, W6, O3, O4, U3
_SEQ = [*_ENC, WFRAMED, WSEQ]

ORACLE["padded_batches"] = _with(*_SEQ) + """,
ordered AS (
  SELECT row_idx, CAST(row_idx % 10 AS BIGINT) AS shard, ids,
         row_number() OVER (ORDER BY row_idx % 10, row_idx) - 1 AS i,
         count(*) OVER () AS n
  FROM wseq),
kept AS (
  SELECT *, CAST(i // 8 AS BIGINT) AS batch, CAST(i % 8 AS BIGINT) AS batch_pos
  FROM ordered WHERE i < (n // 8) * 8)
SELECT batch, batch_pos, row_idx, shard,
       array_to_string(list_concat(ids, list_transform(
           range(max(len(ids)) OVER (PARTITION BY batch) - len(ids)), lambda x: 0)), ' ')
         AS padded
FROM kept"""

ORACLE["iter_batches"] = _with(*_SEQ) + """
SELECT row_idx, CAST(row_idx // 8 AS BIGINT) AS batch FROM wseq
WHERE row_idx < ((SELECT count(*) FROM wseq) // 8) * 8"""

ORACLE["head_rows"] = _with(*_SEQ) + """
SELECT row_idx, array_to_string(ids, ' ') AS ids FROM wseq
WHERE row_idx < (SELECT count(*) FROM wcorpus WHERE split = 'dev')"""

ORACLE["shuffle_rows"] = _with(*_SEQ) + """
SELECT row_idx,
       CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '42', '1', row_idx)), row_idx) - 1
            AS BIGINT) AS order_idx
FROM wseq"""

ORACLE["repeat_epochs"] = _with(*_SEQ) + """
SELECT row_idx, CAST(e.range AS BIGINT) AS epoch FROM wseq, range(3) e"""


# ------------------------------------------------------------------ B1-B8, A4, O2
WFREQ = """wfreq AS MATERIALIZED (SELECT token AS word, count(*) AS freq FROM wtok GROUP BY token),
wsym AS MATERIALIZED (SELECT word, freq, list_append(string_split(word, ''), '</w>') AS s FROM wfreq),
wpair_occ AS (
  SELECT freq, s[i] AS l, s[i + 1] AS r
  FROM (SELECT freq, s, unnest(range(1, len(s))) AS i FROM wsym)),
wstats AS MATERIALIZED (SELECT l, r, CAST(sum(freq) AS BIGINT) AS n FROM wpair_occ GROUP BY l, r)"""
_BPE = [LINES, WTOK, WFREQ]

ORACLE["word_symbols"] = _with(*_BPE) + \
    "SELECT word, freq, array_to_string(s, ' ') AS symbols FROM wsym"

ORACLE["pair_stats"] = _with(*_BPE) + "SELECT l, r, n FROM wstats"

ORACLE["best_pair"] = _with(*_BPE) + """
SELECT l, r, n, CAST(row_number() OVER (ORDER BY n DESC, l, r) - 1 AS BIGINT) AS rank
FROM wstats ORDER BY n DESC, l, r LIMIT 10"""

ORACLE["merge_pair"] = _with(*_BPE) + """,
best AS MATERIALIZED (
  SELECT chr(28) || l || chr(29) || chr(28) || r || chr(29) AS a, chr(28) || l || r || chr(29) AS b
  FROM wstats ORDER BY n DESC, l, r LIMIT 1),
merged AS (
  SELECT word, freq,
         replace(chr(28) || array_to_string(s, chr(29) || chr(28)) || chr(29),
                 (SELECT a FROM best), (SELECT b FROM best)) AS w
  FROM wsym)
SELECT word, freq,
       replace(substr(w, 2, length(w) - 2), chr(29) || chr(28), ' ') AS symbols
FROM merged"""

ORACLE["codes_text_roundtrip"] = _with(*_BPE) + """
SELECT CAST(row_number() OVER (ORDER BY n DESC, l, r) - 1 AS BIGINT) AS rank,
       l AS "left", r AS "right" FROM wstats"""

ORACLE["text_roundtrips"] = _with(LINES, WTOK, WCOUNTS) + """
SELECT CAST(0 AS BIGINT) AS id, 'UNK' AS token
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY freq DESC, token) AS BIGINT) AS id, token
FROM wcounts WHERE freq >= 20 AND token NOT IN ('UNK', '_start_', '_delimiter_', '_end_')"""

ORACLE["rank_codes"] = _with(LINES, WTOK, WFREQ) + """,
a AS (SELECT l, r, row_number() OVER (ORDER BY n DESC, l, r) - 1 AS rank FROM wstats),
b AS (SELECT l, r, row_number() OVER (ORDER BY n, l, r) - 1
             + (SELECT count(*) FROM wstats) AS rank FROM wstats)
SELECT l AS "left", r AS "right", CAST(min(rank) AS BIGINT) AS rank
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY l, r"""

ORACLE["symbol_pairs"] = _with(*_BPE) + """
SELECT word, CAST(count(DISTINCT p) AS BIGINT) AS n_pairs,
       array_to_string(list_sort(list_distinct(list(p))), ' ') AS pairs
FROM (SELECT word, s[i] || chr(31) || s[i + 1] AS p
      FROM (SELECT word, s, unnest(range(1, len(s))) AS i FROM wsym))
GROUP BY word"""


# ------------------------------------------------------------------ pairs
PAIRS = """pairs AS MATERIALIZED (
  SELECT d.doc_id * 16777216 + d.k AS pair_id, p[2 * d.k + 1] AS a,
         coalesce(p[2 * d.k + 2], '') AS b,
         CAST(coalesce(l.toxic, -1) AS BIGINT) AS label
  FROM (SELECT doc_id, p, unnest(range(0, (len(p) + 1) // 2)) AS k
        FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) d
  LEFT JOIN labels l ON l.doc_id = d.doc_id),
ipairs AS (SELECT *, CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS row_idx
           FROM pairs)"""

ORACLE["doc_pairs"] = _with(PAIRS) + "SELECT pair_id, a, b, label FROM pairs"
ORACLE["project_pairs"] = _with(PAIRS) + "SELECT a, b, label FROM pairs"


def _enc_side(col: str) -> str:
    return f"""enc_{col} AS (
  SELECT p.pair_id, list(coalesce(s.id, 0) ORDER BY p.pos) AS ids
  FROM (SELECT pair_id, CAST(generate_subscripts(t, 1) AS BIGINT) AS pos, unnest(t) AS token
        FROM (SELECT pair_id, string_split({col}, ' ') AS t FROM pairs)) p
  LEFT JOIN wspecials s ON s.token = p.token
  GROUP BY p.pair_id)"""


_EPAIRS = [*ALL_W, SPECIALS, PAIRS, _enc_side("a"), _enc_side("b")]

ORACLE["encode_fields"] = _with(*_EPAIRS) + """
SELECT p.pair_id, p.label, array_to_string(ea.ids, ' ') AS a_ids,
       array_to_string(eb.ids, ' ') AS b_ids
FROM pairs p JOIN enc_a ea ON ea.pair_id = p.pair_id JOIN enc_b eb ON eb.pair_id = p.pair_id"""

ORACLE["split_by_index"] = _with(PAIRS) + """
SELECT pair_id, row_idx, CASE WHEN row_idx % 10 = 0 THEN 'dev' ELSE 'train' END AS split
FROM ipairs"""

REPL = """repl AS (
  SELECT row_idx + (k * (SELECT count(*) FROM ipairs)) // 4 AS row_idx
  FROM ipairs, (SELECT range AS k FROM range(4)) ks WHERE row_idx % 10 = 0)"""

ORACLE["replicate_index"] = _with(PAIRS, REPL) + \
    "SELECT CAST(row_idx AS BIGINT) AS row_idx FROM repl"

ORACLE["index_complement"] = _with(PAIRS, REPL) + """
SELECT CAST(row_idx AS BIGINT) AS row_idx FROM (
  (SELECT row_idx FROM repl EXCEPT SELECT range FROM range((SELECT count(*) FROM ipairs)))
  UNION ALL
  (SELECT range FROM range((SELECT count(*) FROM ipairs)) EXCEPT SELECT row_idx FROM repl))"""

ORACLE["stack_columns"] = _with(PAIRS) + """
SELECT CAST(0 AS BIGINT) AS side, row_idx, a AS text FROM ipairs
UNION ALL SELECT CAST(1 AS BIGINT) AS side, row_idx, b AS text FROM ipairs"""

ORACLE["concat_datasets"] = _with(PAIRS) + """
SELECT CAST(row_number() OVER (ORDER BY src, row_idx) - 1 AS BIGINT) AS row_idx, pair_id, label
FROM (SELECT CASE WHEN label >= 0 THEN 0 ELSE 1 END AS src, row_idx, pair_id, label
      FROM ipairs)"""

ORACLE["zip_columns"] = """
WITH d AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS k
      FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
a AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS row_idx, t AS a FROM d WHERE k % 2 = 0),
b AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS row_idx, t AS b FROM d WHERE k % 2 = 1),
l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, toxic AS label FROM labels)
SELECT CAST(coalesce(a.row_idx, b.row_idx, l.row_idx) AS BIGINT) AS row_idx,
       coalesce(a.a, '') AS a, coalesce(b.b, '') AS b,
       CAST(coalesce(l.label, -1) AS BIGINT) AS label
FROM a FULL OUTER JOIN b ON a.row_idx = b.row_idx
       FULL OUTER JOIN l ON coalesce(a.row_idx, b.row_idx) = l.row_idx"""

ORACLE["unstack_halves"] = _with(LINES) + """,
il AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS row_idx, text FROM lines),
n AS (SELECT count(*) AS n FROM il)
SELECT CAST(x.row_idx AS BIGINT) AS row_idx, x.text AS a, y.text AS b
FROM il x, il y, n
WHERE x.row_idx < n.n // 2 AND y.row_idx = x.row_idx + (n.n - n.n // 2)"""

ORACLE["frame_pair"] = _with(*_EPAIRS) + f""",
fp AS (
  SELECT p.pair_id, ea.ids AS a, eb.ids AS b, {NV} AS v
  FROM pairs p JOIN enc_a ea ON ea.pair_id = p.pair_id JOIN enc_b eb ON eb.pair_id = p.pair_id)
SELECT pair_id, CAST(0 AS BIGINT) AS ord,
       CAST(len(x) AS BIGINT) AS len, array_to_string(x, ' ') AS ids
FROM (SELECT pair_id, list_concat([v], a[1:35], [v + 1], b[1:35], [v + 2]) AS x FROM fp)
UNION ALL
SELECT pair_id, CAST(1 AS BIGINT) AS ord,
       CAST(len(x) AS BIGINT) AS len, array_to_string(x, ' ') AS ids
FROM (SELECT pair_id, list_concat([v], b[1:35], [v + 1], a[1:35], [v + 2]) AS x FROM fp)"""

PTERMS = f"""pterms AS MATERIALIZED (
  SELECT pair_id, CASE WHEN count(*) = 2 THEN 's:' ELSE 'u:' END || token AS term
  FROM (SELECT DISTINCT pair_id, side, token FROM (
          SELECT pair_id, 0 AS side, unnest(regexp_split_to_array(a, '{WS}+')) AS token FROM pairs
          UNION ALL
          SELECT pair_id, 1 AS side, unnest(regexp_split_to_array(b, '{WS}+')) AS token FROM pairs)
        WHERE token <> '')
  GROUP BY pair_id, token)"""

# at zero weights every logit is 0, so a pair's error is its class weight times (1/2 - label)
PSTEP = """tr AS (
  SELECT pair_id, label, CASE WHEN label = 1 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS w
  FROM ipairs WHERE row_idx % 10 <> 0 AND label >= 0),
gr AS (SELECT p.term, sum(t.w * (0.5 - t.label)) AS g, count(*) AS n
       FROM tr t JOIN pterms p ON p.pair_id = t.pair_id GROUP BY p.term),
bs AS (SELECT -sum(w * (0.5 - label)) / count(*) AS b, count(*) AS n FROM tr),
zs AS (SELECT p.pair_id, any_value(p.label) AS label, any_value(p.row_idx) AS row_idx,
              (SELECT b FROM bs) + coalesce(sum(-g.g / (SELECT n FROM bs)), 0) AS z
       FROM ipairs p LEFT JOIN pterms f ON f.pair_id = p.pair_id LEFT JOIN gr g ON g.term = f.term
       GROUP BY p.pair_id)"""

ORACLE["pair_features"] = _with(PAIRS, PTERMS) + """
SELECT p.pair_id, any_value(p.label) AS label, count(f.term) AS n_terms,
       coalesce(string_agg(f.term, ' ' ORDER BY f.term), '') AS terms
FROM pairs p LEFT JOIN pterms f ON f.pair_id = p.pair_id GROUP BY p.pair_id"""

ORACLE["pair_gradient"] = _with(PAIRS, PTERMS, PSTEP) + "SELECT term, round(g, 6) + 0.0::DOUBLE AS g, n FROM gr"

ORACLE["pair_loss"] = _with(PAIRS, PTERMS, PSTEP) + """
SELECT CAST(0 AS BIGINT) AS step, count(*) AS n, round(avg(w * ln(2)), 6) AS loss FROM tr
UNION ALL
SELECT CAST(1 AS BIGINT), count(*), round(avg(t.w * ln(1 + exp(CASE WHEN t.label = 1 THEN -z.z ELSE z.z END))), 6)
FROM tr t JOIN zs z ON z.pair_id = t.pair_id"""

ORACLE["pair_logits"] = _with(PAIRS, PTERMS, PSTEP) + """
SELECT pair_id, label, round(z, 6) + 0.0::DOUBLE AS z, CAST(CASE WHEN z > 0 THEN 1 ELSE 0 END AS BIGINT) AS pred
FROM zs"""

ORACLE["char_chain"] = _with(PAIRS) + f""",
st AS (SELECT 0 AS side, row_idx, a AS text FROM ipairs
       UNION ALL SELECT 1, row_idx, b FROM ipairs),
sc AS (
  SELECT token, count(*) AS freq FROM (
    SELECT unnest(list_filter(string_split(regexp_replace(text, '{WS}', '', 'g'), ''),
                              lambda x: x <> '')) AS token FROM st)
  GROUP BY token),
sv AS (SELECT token FROM sc WHERE freq >= 10
       AND token NOT IN ('UNK', '_start_', '_delimiter_', '_end_')),
sch AS (
  SELECT side, row_idx, CAST(generate_subscripts(t, 1) AS BIGINT) AS pos, unnest(t) AS ch
  FROM (SELECT side, row_idx,
               string_split(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '') AS t FROM st)),
su AS (
  SELECT s.side, s.row_idx, coalesce(r.text, '') AS text
  FROM st s LEFT JOIN (
    SELECT c.side, c.row_idx,
           string_agg(CASE WHEN c.ch = '' OR regexp_full_match(c.ch, '{WS}') THEN ''
                           WHEN v.token IS NULL THEN 'UNK' ELSE c.ch END, ' ' ORDER BY c.pos)
             AS text
    FROM sch c LEFT JOIN sv v ON v.token = c.ch
    GROUP BY c.side, c.row_idx) r
  ON s.side = r.side AND s.row_idx = r.row_idx)
SELECT x.row_idx, x.text AS a, y.text AS b, p.label
FROM su x JOIN su y ON x.row_idx = y.row_idx AND x.side = 0 AND y.side = 1
     JOIN ipairs p ON p.row_idx = x.row_idx"""


# ------------------------------------------------------------------ M1-M9, A5-A10, W7, W8, J9
LOGITS = """lg AS (
  SELECT vec_id AS id,
         [list_sum(list_filter(v, lambda x, i: i % 2 = 1)),
          list_sum(list_filter(v, lambda x, i: i % 2 = 0))] AS x,
         CAST(CASE WHEN label = 1 THEN 1 ELSE 0 END AS BIGINT) AS y,
         list_sum(list_transform(v, lambda x: abs(x))) / len(v) AS e2
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
        FROM embeddings)),
ce AS (
  SELECT id, y, x,
         greatest(x[1], x[2]) + ln(exp(x[1] - greatest(x[1], x[2]))
                                   + exp(x[2] - greatest(x[1], x[2]))) - x[y + 1] AS ce,
         CASE WHEN x[2] > x[1] THEN 1 ELSE 0 END AS pred
  FROM lg),
wce AS (SELECT id, y, ((2 * 0.8 - 1) * y + 1 - 0.8) * ce AS loss, pred FROM ce)"""

ORACLE["softmax"] = _with(LOGITS) + """
SELECT id, round(exp(x[1] - m) / (exp(x[1] - m) + exp(x[2] - m)), 6) AS p0,
       round(exp(x[2] - m) / (exp(x[1] - m) + exp(x[2] - m)), 6) AS p1
FROM (SELECT id, x, greatest(x[1], x[2]) AS m FROM lg)"""

ORACLE["cross_entropy"] = _with(LOGITS) + "SELECT id, y, round(ce, 6) AS ce FROM ce"
ORACLE["weighted_cross_entropy"] = _with(LOGITS) + \
    "SELECT id, y, round(loss, 6) AS loss FROM wce"
ORACLE["argmax"] = _with(LOGITS) + "SELECT id, CAST(pred AS BIGINT) AS pred FROM ce"

ORACLE["score_distribution_label"] = _with(LOGITS) + ", sc AS (" + \
    "SELECT id, least(abs(e2) * 5, 5.0) AS s FROM lg)\nSELECT id, round(s, 6) AS score, " + \
    ", ".join(f"round(CASE WHEN {i} = floor(s) + 1 THEN s - floor(s) WHEN {i} = floor(s) "
              f"THEN floor(s) - s + 1 ELSE 0.0 END, 6) AS w{i}" for i in range(6)) + " FROM sc"

ORACLE["f1"] = _with(LOGITS) + """
SELECT tp, fp, fn,
       round(CASE WHEN tp > 0 THEN 100.0 * 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM (SELECT CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN y <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN y = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM wce)"""

ORACLE["row_weighted_cost"] = _with(LOGITS) + """
SELECT round(sum(m * n) / sum(n), 6) AS cost, CAST(sum(n) AS BIGINT) AS n_rows
FROM (SELECT b, avg(loss) AS m, count(*) AS n
      FROM (SELECT (row_number() OVER (ORDER BY id) - 1) // 32 AS b, loss FROM wce) GROUP BY b)"""

WDEV = f"""wdev AS (
  SELECT CAST(row_number() OVER (ORDER BY doc_id, line_no) - 1 AS BIGINT) AS row_idx,
         list_concat([{NV}], ids[1:198], [{NV} + 2]) AS ids
  FROM wenc WHERE split = 'dev')"""


def _targets(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT row_idx AS seq, CAST(i AS BIGINT) AS pos, ids[i] AS prev, ids[i + 1] AS next
  FROM (SELECT row_idx, ids, unnest(range(1, len(ids))) AS i FROM {src}))"""


LMCTE = [*_SEQ, WDEV, _targets("wseq", "ttrain"), _targets("wdev", "tdev"),
         """bigrams AS (SELECT prev, next, count(*) AS c FROM ttrain GROUP BY prev, next),
totals AS (SELECT prev, CAST(sum(c) AS BIGINT) AS t FROM bigrams GROUP BY prev)""",
         f"""plosses AS (
  SELECT d.seq, d.pos, d.next,
         -ln((coalesce(b.c, 0) + 1.0) / (coalesce(t.t, 0) + 1.0 * ({NV} + 3))) AS loss
  FROM tdev d LEFT JOIN bigrams b ON b.prev = d.prev AND b.next = d.next
  LEFT JOIN totals t ON t.prev = d.prev)""",
         "slosses AS (SELECT seq AS row_idx, avg(loss) AS loss FROM plosses GROUP BY seq)"]

ORACLE["next_token_targets"] = _with(*_SEQ, _targets("wseq", "ttrain")) + \
    "SELECT seq, pos, prev, next FROM ttrain"

ORACLE["fit_ngram_lm"] = _with(*LMCTE) + f"""
SELECT b.prev, b.next, b.c, t.t, round(ln((b.c + 1.0) / (t.t + 1.0 * ({NV} + 3))), 6) AS logp
FROM bigrams b JOIN totals t ON t.prev = b.prev"""

ORACLE["score_ngram_lm"] = _with(*LMCTE) + \
    "SELECT seq, pos, round(loss, 6) AS loss, CAST(1.0 AS DOUBLE) AS mask FROM plosses"

ORACLE["masked_seq_loss"] = _with(*LMCTE) + """
SELECT seq AS row_idx,
       round(sum(loss * CAST(sign(next) AS DOUBLE)) / sum(CAST(sign(next) AS DOUBLE)), 6) AS loss
FROM plosses GROUP BY seq"""

ORACLE["perplexity"] = _with(*LMCTE) + """
SELECT round(avg(exp(loss)), 6) AS ppl, round(avg(loss), 6) AS loss, count(*) AS n_seq
FROM slosses"""

ORACLE["batch_averaged_metrics"] = _with(*LMCTE) + """
SELECT round(avg(bl), 6) AS loss, round(avg(bp), 6) AS ppl, count(*) AS n_batches
FROM (SELECT row_idx // 8 AS b, avg(loss) AS bl, avg(exp(loss)) AS bp FROM slosses GROUP BY b)"""

ORACLE["objective"] = _with(LOGITS, *LMCTE) + """
SELECT round(c, 6) AS clf_loss, round(l, 6) AS lm_loss, round(c + 0.5 * l, 6) AS objective
FROM (SELECT (SELECT avg(loss) FROM wce) AS c, (SELECT avg(loss) FROM slosses) AS l)"""

ORACLE["every_n_steps"] = _with(*LMCTE) + """
SELECT row_idx AS step, 'loss' AS name, round(loss, 6) AS value FROM slosses
WHERE row_idx % 100 = 0"""

# Char vocabulary of the corpus; both pair sides char-unk-replaced, encoded with the
# specials, framed both ways (n_ctx 73), then token and position vectors added per position.
CNV = "(SELECT count(*) FROM cvocab)"
J9 = f"""pst AS (SELECT pair_id, 0 AS side, a AS text FROM pairs
        UNION ALL SELECT pair_id, 1 AS side, b AS text FROM pairs),
pch AS (
  SELECT pair_id, side, generate_subscripts(t, 1) AS pos, unnest(t) AS ch
  FROM (SELECT pair_id, side,
               string_split(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '') AS t FROM pst)),
punk AS (
  SELECT s.pair_id, s.side, coalesce(r.text, '') AS text
  FROM pst s LEFT JOIN (
    SELECT c.pair_id, c.side,
           string_agg(CASE WHEN c.ch = '' OR regexp_full_match(c.ch, '{WS}') THEN ''
                           WHEN v.id IS NULL THEN 'UNK' ELSE c.ch END, ' ' ORDER BY c.pos) AS text
    FROM pch c LEFT JOIN cvocab v ON v.token = c.ch AND v.id > 0
    GROUP BY c.pair_id, c.side) r
  ON s.pair_id = r.pair_id AND s.side = r.side),
cspecials AS (
  SELECT id, token FROM cvocab
  UNION ALL SELECT {CNV}, '_start_' UNION ALL SELECT {CNV} + 1, '_delimiter_'
  UNION ALL SELECT {CNV} + 2, '_end_'),
penc AS (
  SELECT p.pair_id, p.side, list(coalesce(s.id, 0) ORDER BY p.pos) AS ids
  FROM (SELECT pair_id, side, generate_subscripts(t, 1) AS pos, unnest(t) AS token
        FROM (SELECT pair_id, side, string_split(text, ' ') AS t FROM punk)) p
  LEFT JOIN cspecials s ON s.token = p.token
  GROUP BY p.pair_id, p.side),
pfr AS (
  SELECT x.pair_id, o.ord,
         CASE WHEN o.ord = 0
              THEN list_concat([v.v], x.ids[1:35], [v.v + 1], y.ids[1:35], [v.v + 2])
              ELSE list_concat([v.v], y.ids[1:35], [v.v + 1], x.ids[1:35], [v.v + 2]) END AS ids
  FROM penc x JOIN penc y ON x.pair_id = y.pair_id AND x.side = 0 AND y.side = 1,
       (SELECT range AS ord FROM range(2)) o, (SELECT {CNV} AS v) v),
ppos AS (
  SELECT pair_id, ord, CAST(generate_subscripts(ids, 1) - 1 AS BIGINT) AS pos,
         unnest(ids) AS id
  FROM pfr),
hvec AS (
  SELECT p.pair_id, p.ord, p.pos, p.id, p.pos + {CNV} + 3 AS pos_id,
         CASE WHEN t.embedding IS NOT NULL AND q.embedding IS NOT NULL THEN
           list_transform(list_zip(t.embedding, q.embedding),
                          lambda z: CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE)) END AS h
  FROM ppos p LEFT JOIN embeddings t ON t.vec_id = p.id
  LEFT JOIN embeddings q ON q.vec_id = p.pos + {CNV} + 3)"""

ORACLE["embedding_lookup_sum"] = _with(LINES, CTOK, CCOUNTS, CVOCAB, PAIRS, J9) + """
SELECT pair_id, ord, pos, CAST(id AS BIGINT) AS id, CAST(pos_id AS BIGINT) AS pos_id,
       CAST(len(h) AS BIGINT) AS dim,
       round(round(list_reduce(h, lambda a, x: a + x), 4), 6) AS h_sum,
       round(round(list_reduce(list_transform(h, lambda x: x * x), lambda a, x: a + x), 4), 6)
         AS h_sq
FROM hvec"""


# ------------------------------------------------------------------ S2-S12 round trips, R1
ORACLE["pairs_tsv_roundtrip"] = _with(PAIRS) + """
SELECT row_idx AS pair_id, p[1] AS a, p[2] AS b,
       CAST(CASE WHEN len(p) < 3 THEN -1 ELSE CAST(p[len(p)] AS INTEGER) END AS BIGINT) AS label
FROM (SELECT row_idx, string_split(a || chr(9) || b || chr(9) || CAST(label AS VARCHAR), chr(9)) AS p
      FROM ipairs)"""

ORACLE["inference_pairs_roundtrip"] = _with(PAIRS) + """
SELECT coalesce(p[1], '') AS "index", coalesce(p[2], '') AS a, coalesce(p[3], '') AS b
FROM (SELECT string_split(CAST(pair_id AS VARCHAR) || chr(9) || a || chr(9) || b, chr(9)) AS p
      FROM pairs)"""

ORACLE["vocab_roundtrip"] = ORACLE["vocab_word"]

ORACLE["counts_roundtrip"] = _with(LINES, WTOK, WCOUNTS) + "SELECT token, freq FROM wcounts"

ORACLE["split_roundtrip"] = ORACLE["prepare_corpus"]

ORACLE["sequences_roundtrip"] = ORACLE["prepare_sequences"]

ORACLE["split_index_roundtrip"] = _with(PAIRS) + \
    "SELECT row_idx FROM ipairs WHERE row_idx % 10 = 0"

ORACLE["metrics_roundtrip"] = _with(*LMCTE) + """
SELECT row_idx AS step, 'loss' AS name, round(loss, 6) AS value, true AS stamped FROM slosses"""

ORACLE["predictions_roundtrip"] = _with(LOGITS) + """
SELECT CAST(id AS VARCHAR) AS "index", CAST(pred AS VARCHAR) AS label FROM ce"""

ORACLE["stream_token_counts"] = _with(LINES, WTOK) + \
    "SELECT token, count(*) AS freq FROM wtok GROUP BY token"


# a row enters buffer entry ``e`` in step ``i`` and leaves at the entry's next draw; the last ones
# leave by their keys
ORACLE["shuffle_buffer"] = _with(*_SEQ) + """,
nb AS (SELECT count(*) // 8 AS n, least(1000, count(*) // 8) AS size FROM wseq),
bt AS (SELECT CAST(range AS BIGINT) AS batch, n, size FROM nb, range((SELECT n FROM nb))),
en AS (SELECT batch, n, size, greatest(batch - size, -1) AS i,
              CASE WHEN batch < size THEN batch
                   ELSE CAST('0x' || substr(md5(concat_ws(':', '42', '1', '0', batch - size)), 1, 8) AS BIGINT)
                        % size END AS e
       FROM bt),
gone AS (SELECT *, lead(i) OVER (PARTITION BY e ORDER BY i) AS o FROM en)
SELECT batch, CAST(CASE WHEN o IS NOT NULL THEN o ELSE n - size - 1 + row_number() OVER (
         PARTITION BY o IS NULL ORDER BY CAST('0x' || substr(md5(concat_ws(':', '42', '1', '0', 'end', batch)),
                                                             1, 8) AS BIGINT), batch) END AS BIGINT) AS order_idx
FROM gone"""

ORACLE["shuffle_batches"] = _with(*ALL_W, SPECIALS, WUNK, WCORPUS, WENC, WDEV) + """
SELECT row_idx, CAST(row_idx // 8 AS BIGINT) AS batch,
       CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '42', '1', row_idx // 8)), row_idx // 8,
                               row_idx) - 1 AS BIGINT) AS order_idx
FROM wdev"""
