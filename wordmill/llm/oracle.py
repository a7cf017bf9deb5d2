"""DuckDB statements of the pipeline operators that SQL can express."""

ORACLE: dict[str, str] = {}

# op4: digest of the text without white space, the longest original text wins
ORACLE["op4_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
    FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM d
WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def _merkle() -> str:
    """op13 level by level: 8 levels per source and 8 above hold any table."""
    levels = 8
    sha = "sha256({})".format
    enc = ("CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || "
           "CAST({0} AS VARCHAR) END").format
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # crc32 of a decimal number, digit by digit and bit by bit
    crc = ("xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform("
           "string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), "
           "lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: i::UBIGINT)), "
           "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), "
           "4294967295::UBIGINT)")
    own = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    side = ("coalesce(string_agg({0}, '') OVER (PARTITION BY s, idx // 16 ORDER BY idx "
            "ROWS BETWEEN {1}), '')").format
    left, right = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"
    sql = f"""WITH t0 AS (
  SELECT doc_id, source, text, {own} AS own,
         CASE WHEN {crc} % 5 = 0 THEN translate(text, '{upper}', '{lower}') ELSE text END AS now_text
  FROM documents),
t1 AS (SELECT doc_id, source, {sha("own || " + enc("text"))} AS leaf,
              {sha("own || " + enc("now_text"))} AS now FROM t0),
docs AS (
  SELECT *, coalesce('s' || source, '') AS s,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS idx,
         row_number() OVER () AS k
  FROM t1),
a0 AS (SELECT s, idx, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM docs)"""

    def climb(name: str, n_levels: int) -> str:
        """Levels name0..nameN (s, idx, h, n) with their siblings in nameSk (left l, right r)."""
        out = ""
        for k in range(n_levels):
            out += f""",
{name}s{k} AS (SELECT s, idx, n, {side("h", left)} AS l, {side("h", right)} AS r FROM {name}{k} WHERE n > 1),
{name}{k + 1} AS (
  SELECT s, idx // 16 AS idx, {sha("string_agg(h, '' ORDER BY idx)")} AS h, any_value((n + 15) // 16) AS n
  FROM {name}{k} WHERE n > 1 GROUP BY s, idx // 16
  UNION ALL SELECT s, idx, h, n FROM {name}{k} WHERE n = 1)"""
        return out

    def fold(name: str, n_levels: int, start: str) -> str:
        """Rows (k, s, idx, state, proof) carried up the levels."""
        out, prev = "", start
        for k in range(n_levels):
            out += f""",
{name}f{k} AS (
  SELECT p.k, p.s, CASE WHEN q.s IS NULL THEN p.idx ELSE p.idx // 16 END AS idx,
         CASE WHEN q.s IS NULL THEN p.state ELSE {sha("q.l || p.state || q.r")} END AS state,
         p.proof || coalesce(q.l || q.r, '') AS proof
  FROM {prev} p LEFT JOIN {name}s{k} q ON p.s = q.s AND p.idx = q.idx)"""
            prev = f"{name}f{k}"
        return out

    sql += climb("a", levels)
    sql += f""",
b0 AS (SELECT '' AS s, row_number() OVER (ORDER BY s) - 1 AS idx, h, count(*) OVER () AS n, s AS src
       FROM a{levels})"""
    sql += climb("b", levels)
    sql += """,
p0 AS (SELECT k, s, idx, now AS state, '' AS proof FROM docs)"""
    sql += fold("a", levels, "p0")
    sql += f""",
p1 AS (SELECT f.k, '' AS s, b0.idx, f.state, f.proof FROM af{levels - 1} f JOIN b0 ON f.s = b0.src)"""
    sql += fold("b", levels, "p1")
    return sql + f"""
SELECT d.doc_id, d.leaf, a.h AS subroot, r.h AS root, {sha("f.proof")} AS proof_sha256,
       f.state AS folded_root, f.state = r.h AS verified
FROM docs d JOIN bf{levels - 1} f ON d.k = f.k JOIN a{levels} a ON a.s = d.s, b{levels} r
"""


# op13: windows for siblings, one pair of statements per level
ORACLE["op13_merkle_manifest"] = _merkle()
