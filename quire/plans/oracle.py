"""DuckDB twins of the registered queries (the correctness gate).

Shared fragments are common-table expressions composed into each query. They
run on the pre-registered views (``documents``, ``events`` ...). DuckDB
lambdas use the ``lambda x: ...`` form.
"""

from __future__ import annotations

import unicodedata

from quire.plans import params as P
from quire.sources import registry as R

V = P.VOCAB_SIZE
S = P.SEQ_LEN
W = P.SHARDS

def _broken(x: str) -> str:
    for t in P.TERMINATORS:
        x = f"replace({x}, '{t}', '{t}' || chr(10))"
    return x


_BROKEN = _broken("text")

# words of every document, in order
CTE_WORDS = r"""
wl AS (
  SELECT doc_id, list_filter(
           regexp_split_to_array(
             regexp_replace(text, '(<pad>|<mask>|<\|im_start\|>|<\|im_end\|>)', ' \1 ', 'g'),
             '[ \t\n\r]+'),
           lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL
),
w AS (SELECT doc_id, unnest(range(len(ws))) AS wpos, unnest(ws) AS word FROM wl)
"""

# learned word pieces: the VOCAB_SIZE most frequent words
CTE_VOCAB = f"""
wc AS (
  SELECT word, count(*) AS cnt FROM w
  WHERE word NOT IN ('<pad>', '<mask>', '<|im_start|>', '<|im_end|>') GROUP BY word
),
vocab AS (
  SELECT word, CAST(262 + rk AS INTEGER) AS id, cnt FROM (
    SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word ASC) AS rk FROM wc) t
  WHERE rk <= {V}
)
"""


def cte_encode(src: str = "w", id_col: str = "doc_id", name: str = "enc") -> str:
    """Encode words of ``src`` (id, wpos, word) into ``name`` (id, ids)."""
    return f"""
{name}_tok AS (
  SELECT s.{id_col}, s.wpos,
    CASE WHEN s.word = '<pad>' THEN [3] WHEN s.word = '<mask>' THEN [4]
         WHEN s.word = '<|im_start|>' THEN [5] WHEN s.word = '<|im_end|>' THEN [6]
         WHEN v.id IS NOT NULL THEN [v.id]
         ELSE list_transform(regexp_extract_all(hex(encode('▁' || s.word)), '[0-9A-F]{{2}}'),
                             lambda h: CAST(('0x' || h) AS INTEGER) + 7) END AS p
  FROM {src} s LEFT JOIN vocab v ON s.word = v.word
),
{name} AS (SELECT {id_col}, flatten(list(p ORDER BY wpos)) AS ids FROM {name}_tok GROUP BY {id_col})
"""


def words_of(table: str, id_col: str, text_col: str, name: str) -> str:
    """Word rows ``name`` (id, wpos, word) of any text column."""
    return rf"""
{name}_l AS (
  SELECT {id_col}, list_filter(
           regexp_split_to_array(
             regexp_replace({text_col}, '(<pad>|<mask>|<\|im_start\|>|<\|im_end\|>)', ' \1 ', 'g'),
             '[ \t\n\r]+'),
           lambda x: x <> '') AS ws
  FROM {table} WHERE {text_col} IS NOT NULL
),
{name} AS (SELECT {id_col}, unnest(range(len(ws))) AS wpos, unnest(ws) AS word FROM {name}_l)
"""


def cte_shards(src: str, n_shards: int) -> str:
    """``dshard(doc_id, pos, shard)``: contiguous shards over ``src(doc_id, pos, n)``."""
    w = n_shards
    return f"""
dshard AS (
  SELECT doc_id, pos,
    CAST(CASE WHEN n // {w} = 0 THEN pos
              WHEN pos < (n % {w}) * (n // {w} + 1) THEN pos // (n // {w} + 1)
              ELSE (n % {w}) + (pos - (n % {w}) * (n // {w} + 1)) // (n // {w}) END AS INTEGER) AS shard
  FROM {src}
)
"""


# token stream of the shards, laid end to end with EOS, with stream offsets
CTE_PACK_STREAM = f"""
st AS (
  SELECT d.shard, d.pos, d.doc_id, e.ids || [2] AS toks
  FROM dshard d JOIN enc e USING (doc_id) WHERE len(e.ids) > 0
),
st_off AS (
  SELECT shard, pos, doc_id, toks,
         sum(len(toks)) OVER (PARTITION BY shard ORDER BY pos ROWS UNBOUNDED PRECEDING) - len(toks) AS start,
         sum(len(toks)) OVER (PARTITION BY shard) AS tot
  FROM st
),
tok AS (
  SELECT shard, doc_id, tot, start + unnest(range(len(toks))) AS p, unnest(toks) AS t FROM st_off
),
tokb AS (SELECT *, greatest((tot - 1) // {S}, 0) AS nb FROM tok)
"""

# documents in doc_id order with contiguous shards over the raw stream
CTE_STREAM = (
    "dpos AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),\n"
    + cte_shards("dpos", W).strip()
    + ",\n"
    + CTE_PACK_STREAM.strip()
    + "\n"
)

# full packed blocks
CTE_BLOCKS = f"""
blk_in AS (
  SELECT shard, p // {S} AS block_id, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY p) AS input_ids,
         arg_min(doc_id, p) AS first_doc_id
  FROM tokb WHERE p // {S} < nb GROUP BY shard, p // {S}
),
blk_lab AS (
  SELECT shard, (p - 1) // {S} AS block_id, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY p) AS labels
  FROM tokb WHERE p >= 1 AND (p - 1) // {S} < nb GROUP BY shard, (p - 1) // {S}
),
blocks AS (
  SELECT i.shard, CAST(i.block_id AS BIGINT) AS block_id, i.input_ids, l.labels, i.first_doc_id
  FROM blk_in i JOIN blk_lab l USING (shard, block_id)
)
"""

ONES = " ".join(["1"] * S)


def _q(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


ORACLE: dict[str, str] = {}

ORACLE["e_words"] = _q(CTE_WORDS, CTE_VOCAB, body="SELECT id, word, CAST(cnt AS BIGINT) AS cnt FROM vocab")

ORACLE["f_encode"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(),
    body="SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5 FROM enc",
)

ORACLE["g_pack"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM, CTE_BLOCKS,
    body=f"SELECT shard, block_id, input_ids, labels, '{ONES}' AS attention_mask FROM blocks",
)

ORACLE["flagship"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM, CTE_BLOCKS,
    body="""
SELECT CASE pmod(CAST(substr(d.source, 4) AS INTEGER), 6)
         WHEN 0 THEN 'literature' WHEN 1 THEN 'wiki' WHEN 2 THEN 'textbook'
         WHEN 3 THEN 'research' WHEN 4 THEN 'web' ELSE 'cc100' END AS genre,
       count(*) AS n_blocks
FROM blocks b JOIN documents d ON b.first_doc_id = d.doc_id GROUP BY 1
""".replace("pmod(CAST(substr(d.source, 4) AS INTEGER), 6)", "(CAST(substr(d.source, 4) AS INTEGER) % 6)"),
)


# --------------------------------------------------------------------------- A / C

GENRES = ("literature", "wiki", "textbook", "research", "web", "cc100")
GENRE_CASE = (
    "CASE CAST(substr(source, 4) AS INTEGER) % 6 "
    + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GENRES))
    + " END"
)
CTE_GDOCS = f"gdocs AS (SELECT doc_id, text, {GENRE_CASE} AS genre FROM documents)"


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def cte_mix(preset: str, seed: int, strategy: str) -> str:
    """The interleave law in plain windows: draws, occurrences, exhaustion points."""
    from quire.operators.mix import PRESETS, cumulative

    mix = PRESETS[preset]
    genres, weights = list(mix), list(mix.values())
    cum = cumulative(weights)
    mix_rows = ", ".join(f"({i}, '{g}', {_dbl(w)})" for i, (g, w) in enumerate(zip(genres, weights)))
    case = "CASE " + " ".join(f"WHEN u < {_dbl(c)} THEN {i}" for i, c in enumerate(cum)) + f" ELSE {len(cum) - 1} END"
    if strategy == "first_exhausted":
        cut, row, extra = "min(ks)", "o.occ", ""
    elif strategy == "all_exhausted":
        cut, row, extra = "max(ks)", "o.occ % o.n", ""
    else:
        cut, row, extra = "max(ks)", "o.occ", " AND o.occ < o.n"
    return f"""
{CTE_GDOCS},
mixw(gi, genre, w) AS (VALUES {mix_rows}),
ncount AS (SELECT genre, count(*) AS n FROM gdocs GROUP BY genre),
ndraw AS (SELECT CAST(4 * ceil(max(ncount.n / mixw.w)) + 1000 AS BIGINT) AS nd FROM ncount JOIN mixw USING (genre)),
draws AS (
  SELECT k, CAST(('0x' || substr(md5('{seed}:' || CAST(k AS VARCHAR)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM (SELECT unnest(range(nd)) AS k FROM ndraw)
),
src AS (SELECT k, {case} AS gi FROM draws),
occ AS (
  SELECT s.k, s.gi, m.genre, c.n, row_number() OVER (PARTITION BY s.gi ORDER BY s.k) - 1 AS occ
  FROM src s JOIN mixw m USING (gi) JOIN ncount c ON c.genre = m.genre
),
kss AS (SELECT gi, min(k) AS ks FROM occ WHERE occ = n - 1 GROUP BY gi),
cut AS (SELECT {cut} AS kc FROM kss),
granked AS (SELECT genre, doc_id, text, row_number() OVER (PARTITION BY genre ORDER BY doc_id) - 1 AS rnk FROM gdocs),
mixed AS (
  SELECT o.k, o.genre, o.occ, r.doc_id, r.text
  FROM occ o JOIN cut ON o.k <= cut.kc JOIN granked r ON r.genre = o.genre AND r.rnk = {row}
  WHERE TRUE{extra}
)
"""


ORACLE["a_registry"] = f"""
WITH {CTE_GDOCS},
reg(genre, name, text_column, splits) AS (VALUES
  {", ".join(f"('{g}', {repr('ja') if g == 'cc100' else 'NULL'}, 'text', 'train')" for g in GENRES)}),
sizes AS (SELECT genre, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM gdocs GROUP BY genre)
SELECT r.genre, CAST(r.name AS VARCHAR) AS name, r.text_column, r.splits, s.n_docs, s.n_chars
FROM reg r LEFT JOIN sizes s USING (genre)
"""

ORACLE["a_read_source"] = f"WITH {CTE_GDOCS} SELECT doc_id, genre, text FROM gdocs WHERE genre = 'wiki'"

ORACLE["a_preview"] = f"""
WITH {CTE_GDOCS},
r AS (SELECT genre, text, row_number() OVER (PARTITION BY genre ORDER BY doc_id) AS i FROM gdocs)
SELECT genre, CAST(i AS BIGINT) AS i, 'Sample ' || CAST(i AS VARCHAR) || ': ' || substr(text, 1, 100) || '...' AS line
FROM r WHERE i <= 3
"""


def _presets_sql() -> str:
    from quire.operators.mix import PRESETS

    rows = ", ".join(f"('{p}', '{g}', {_dbl(w)})" for p, m in PRESETS.items() for g, w in m.items())
    return f"""
WITH {CTE_GDOCS},
pr(preset, genre, weight) AS (VALUES {rows}),
sizes AS (SELECT genre, count(*) AS n_docs FROM gdocs GROUP BY genre)
SELECT p.genre, p.preset, p.weight, s.n_docs FROM pr p LEFT JOIN sizes s USING (genre)
"""


ORACLE["c_presets"] = _presets_sql()
for _name, _strategy in (
    ("c_first", "first_exhausted"),
    ("c_all", "all_exhausted"),
    ("c_without_replacement", "all_exhausted_without_replacement"),
):
    ORACLE[_name] = "WITH " + cte_mix(P.MIX_PRESET, P.SEED, _strategy).strip() + "\nSELECT k, genre, doc_id FROM mixed"

ORACLE["c_single"] = f"""
WITH {CTE_GDOCS}
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id FROM gdocs WHERE genre = 'literature'
"""


# --------------------------------------------------------------------------- D


ORACLE["d_shuffle"] = (
    "WITH "
    + cte_mix(P.MIX_PRESET, P.SEED, "all_exhausted_without_replacement").strip()
    + f"""
SELECT row_number() OVER (ORDER BY md5('{P.SEED}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)), doc_id, k) - 1 AS spos,
       doc_id
FROM mixed"""
)

ORACLE["d_block_shuffle"] = f"""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT (pos // {P.SHUFFLE_BUFFER}) * {P.SHUFFLE_BUFFER}
       + row_number() OVER (PARTITION BY pos // {P.SHUFFLE_BUFFER}
                            ORDER BY md5('{P.SEED}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR)), pos) - 1 AS spos,
       doc_id
FROM p
"""

def cte_buffer(src: str, name: str) -> str:
    """``name`` (doc_id, pos, n): the rows of ``src`` (doc_id, pos0) as a shuffle buffer hands them out."""
    b, seed = P.SHUFFLE_BUFFER, P.SEED
    return f"""
{name}_slot AS (
  SELECT doc_id, pos0, count(*) OVER () AS n,
         CASE WHEN pos0 < {b} THEN pos0 ELSE CAST('0x' || substr(md5('{seed}:slot:' || CAST(pos0 - {b} AS VARCHAR)), 1, 13) AS BIGINT) % {b} END AS slot
  FROM {src}
),
{name}_out AS (SELECT *, lead(pos0) OVER (PARTITION BY slot ORDER BY pos0) - {b} AS leaves FROM {name}_slot),
{name} AS (
  SELECT doc_id, n, coalesce(leaves, greatest(n - {b}, 0) + row_number() OVER (
           PARTITION BY leaves IS NULL ORDER BY md5('{seed}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(pos0 AS VARCHAR)), pos0) - 1) AS pos
  FROM {name}_out
)"""


ORACLE["d_buffer_shuffle"] = f"""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos0 FROM documents),{cte_buffer("p", "shuffled")}
SELECT pos AS spos, doc_id FROM shuffled
"""

_SHARD3 = """
CAST(CASE WHEN n // 3 = 0 THEN pos
          WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1)
          ELSE (n % 3) + (pos - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER)"""

ORACLE["d_shard_contig"] = f"""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, pos, {_SHARD3} AS shard FROM p
"""

ORACLE["d_shard_mod"] = """
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, pos, CAST(pos % 3 AS INTEGER) AS shard FROM p
"""

ORACLE["d_limit"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM,
    body=f"""
SELECT shard, doc_id, shard_pos FROM (
  SELECT shard, doc_id, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS shard_pos FROM st) t
WHERE shard_pos < {P.MAX_SAMPLES}
""",
)

CTE_SHUF = f"""
shuf AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY md5('{P.SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos
  FROM documents
)
"""

ORACLE["d_corpus_rows"] = _q(CTE_SHUF, body=f"SELECT pos, doc_id FROM shuf WHERE pos < {P.MAX_DOCUMENTS}")

ORACLE["d_corpus_bytes"] = _q(
    CTE_SHUF,
    f"""
lines AS (
  SELECT pos, doc_id,
         sum(octet_length(encode({_BROKEN} || chr(10))))
           OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum_bytes
  FROM shuf
),
stop AS (SELECT min(pos) AS s FROM lines WHERE pos % {P.BYTE_CHECK_EVERY} = 0 AND cum_bytes >= {P.MAX_BYTES})
""",
    body="SELECT pos, doc_id, CAST(cum_bytes AS BIGINT) AS cum_bytes FROM lines, stop WHERE (stop.s IS NULL OR pos <= stop.s) AND pos < " + str(P.BYTE_CAP_DOCUMENTS),
)

CTE_EVAL = _q(
    CTE_WORDS, CTE_VOCAB, words_of("benchmark", "item_id", "text", "bw"), cte_encode("bw", "item_id", "benc"),
    f"""
ev AS (
  SELECT item_id, [1] || ids[1:{P.EVAL_MAX_LEN - 2}] || [2] AS ids,
         CAST((row_number() OVER (ORDER BY item_id) - 1) // {P.EVAL_BATCH} AS BIGINT) AS batch_id
  FROM benc
)
""",
    body="",
)[len("WITH "):]

ORACLE["d_eval_batches"] = (
    "WITH " + CTE_EVAL
    + f"SELECT item_id, batch_id, batch_id = 0 AS holdout FROM ev WHERE batch_id < {P.MAX_EVAL_BATCHES}"
)

ORACLE["d_every_nth"] = f"""
SELECT event_id AS step, event_type AS tag, value FROM events WHERE (event_id + 1) % {P.CHECKPOINT_INTERVAL} = 0
"""


# --------------------------------------------------------------------------- B


ORACLE["b_usable"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(),
    body="SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens FROM enc WHERE len(ids) > 0",
)

ORACLE["b_sentences"] = f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, line FROM (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT doc_id, string_split({_BROKEN} || chr(10), chr(10)) AS ls
    FROM documents WHERE text IS NOT NULL) a) b
WHERE line <> ''
"""

ORACLE["b_trainer_lines"] = """
WITH l AS (SELECT octet_length(encode(unnest(string_split(text, chr(10))))) AS n FROM documents)
SELECT 'read' AS part, count(*) AS lines, CAST(coalesce(sum(n), 0) AS BIGINT) AS bytes FROM l WHERE n BETWEEN 1 AND 4192
UNION ALL
SELECT 'skipped', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM l WHERE n > 4192
"""


def _rules_sql(x: str) -> str:
    for src, tgt in P.NORMALISE_RULES:
        x = f"replace({x}, '{src}', '{tgt.replace(chr(39), chr(39) * 2)}')"
    return x


_NORM = f"trim(regexp_replace({_rules_sql('text')}, '[ \\t\\n\\r]+', ' ', 'g'))"
ORACLE["b_normalise"] = f"""
WITH n AS (SELECT doc_id, {_NORM} AS x FROM documents)
SELECT doc_id,
       md5(CASE WHEN length(x) > 0 THEN '▁' || replace(x, ' ', '▁') ELSE x END) AS norm_md5,
       CAST(length(CASE WHEN length(x) > 0 THEN '▁' || replace(x, ' ', '▁') ELSE x END) AS INTEGER) AS n_chars
FROM n
"""



def _compatibility_rows() -> str:
    """VALUES of every character that a compatibility mapping changes, with its full decomposition (by rule, from
    the Unicode data of Python). NFKC is NFC of the text with these in place."""
    rows = []
    for c in (*range(0xD800), *range(0xE000, 0x110000)):
        ch = chr(c)
        if (full := unicodedata.normalize("NFKD", ch)) != unicodedata.normalize("NFD", ch):
            rows.append("(" + repr(c) + ", '" + full.replace("'", "''") + "')")
    return ", ".join(rows)


_Q = chr(39) * 2
ORACLE["b_nfkc"] = rf"""
WITH compat(c, decomposed) AS (VALUES {_compatibility_rows()}),
raw AS (SELECT doc_id, replace(replace(replace(replace(text, '«', '"'), '»', '"'), '…', '...'), '’', '{_Q}') AS t FROM documents),
ch AS (SELECT doc_id, unnest(string_split(t, '')) AS x, unnest(range(len(string_split(t, '')))) AS i FROM raw),
composed AS (SELECT doc_id, nfc_normalize(coalesce(string_agg(coalesce(decomposed, x), '' ORDER BY i), '')) AS t
          FROM ch LEFT JOIN compat ON c = ord(x) GROUP BY doc_id),
nmt AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\x00-\x08\x0B\x0E-\x1F\x7F\x{{8F}}\x{{9F}}]', '', 'g'),
          '[\t\n\r\x0C\x{{1680}}\x{{2000}}-\x{{200F}}\x{{2028}}\x{{2029}}\x{{205F}}\x{{2581}}\x{{3000}}\x{{FEFF}}\x{{FFFD}}]', ' ', 'g') AS t FROM composed),
n AS (SELECT doc_id, trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g')) AS x FROM nmt)
SELECT doc_id,
       md5(CASE WHEN length(x) > 0 THEN '▁' || replace(x, ' ', '▁') ELSE x END) AS norm_md5,
       CAST(length(CASE WHEN length(x) > 0 THEN '▁' || replace(x, ' ', '▁') ELSE x END) AS INTEGER) AS n_chars
FROM n
"""

CTE_BENC = [CTE_WORDS, CTE_VOCAB, words_of("benchmark", "item_id", "text", "bw"), cte_encode("bw", "item_id", "benc")]

ORACLE["b_prompt_crop"] = _q(
    *CTE_BENC,
    body=f"""
SELECT item_id, array_to_string(x[greatest(len(x) - {P.CROP - 1}, 1):], ' ') AS ids
FROM (SELECT item_id, [2] || ids AS x FROM benc) t
""",
)

# --------------------------------------------------------------------------- E

CTE_CHARS = """
cc AS (SELECT ch, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) a
       WHERE ch <> '' GROUP BY ch),
cr AS (
  SELECT ch, cnt,
         coalesce(sum(cnt) OVER (ORDER BY cnt DESC, ch ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(cnt) OVER () AS total,
         row_number() OVER (ORDER BY cnt DESC, ch ASC) AS rk
  FROM cc
)
"""
_COV = int(round(P.COVERAGE * 1_000_000))

ORACLE["e_alphabet"] = _q(CTE_CHARS, body=f"SELECT ch, cnt FROM cr WHERE before * 1000000 < total * {_COV}")
ORACLE["e_chars"] = _q(
    CTE_CHARS,
    body=f"SELECT CAST(262 + rk AS INTEGER) AS id, ch AS piece, round(ln(cnt / total), 6) AS score FROM cr WHERE before * 1000000 < total * {_COV}",
)


def _merges_sql(n: int) -> str:
    o, c = "chr(2)", "chr(3)"
    parts = [
        CTE_WORDS.strip(),
        f"""m0 AS (
  SELECT array_to_string(list_transform(regexp_extract_all('▁' || word, '(?s).'), lambda ch: {o} || ch || {c}), '') AS s,
         count(*) AS freq
  FROM w WHERE word NOT IN ('<pad>', '<mask>', '<|im_start|>', '<|im_end|>') GROUP BY word)""",
    ]
    sel = []
    for i in range(n):
        parts.append(
            f"""y{i} AS (SELECT regexp_extract_all(s, {o} || '([^' || {c} || ']*)' || {c}, 1) AS y, freq FROM m{i}),
p{i} AS (SELECT y[i] AS l, y[i + 1] AS r, freq FROM (SELECT y, freq, unnest(range(1, len(y))) AS i FROM y{i}) t),
b{i} AS (SELECT l, r, CAST(sum(freq) AS BIGINT) AS cnt FROM p{i} GROUP BY l, r ORDER BY cnt DESC, l ASC, r ASC LIMIT 1),
m{i + 1} AS (SELECT replace(s, {o} || b{i}.l || {c} || {o} || b{i}.r || {c}, {o} || b{i}.l || b{i}.r || {c}) AS s, freq FROM m{i}, b{i})"""
        )
        sel.append(f"SELECT CAST({i} AS INTEGER) AS merge_idx, l, r, cnt FROM b{i}")
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL\n".join(sel)


ORACLE["e_merges3"] = _merges_sql(P.BPE_MERGES)

ORACLE["e_seeds"] = _q(
    CTE_WORDS, CTE_VOCAB,
    f"""
st AS (SELECT word, cnt, unnest(range(1, length(word) + 1)) AS st FROM wc),
subs AS (SELECT cnt, substr(word, st, n) AS piece
         FROM (SELECT word, cnt, st, unnest(range(1, least({P.SEED_MAX_LEN}, length(word) - st + 1) + 1)) AS n FROM st) t),
agg AS (SELECT piece, CAST(sum(cnt) AS BIGINT) AS freq FROM subs GROUP BY piece)
""",
    body=f"""
SELECT piece, freq, score FROM (
  SELECT piece, freq, freq * length(piece) AS score,
         row_number() OVER (ORDER BY freq * length(piece) DESC, piece ASC) AS rk FROM agg) t
WHERE rk <= {P.SEED_PIECES}
""",
)

_SPECIAL_ROWS = ", ".join(
    f"({i}, '{p}', '{t}')"
    for i, p, t in [
        (0, "<unk>", "UNKNOWN"), (1, "<s>", "CONTROL"), (2, "</s>", "CONTROL"), (3, "<pad>", "USER_DEFINED"),
        (4, "<mask>", "USER_DEFINED"), (5, "<|im_start|>", "USER_DEFINED"), (6, "<|im_end|>", "USER_DEFINED"),
    ]
)
CTE_PIECES = f"""
specials(id, piece, type) AS (VALUES {_SPECIAL_ROWS}),
pt AS (
  SELECT CAST(id AS INTEGER) AS id, piece, type, CAST(0 AS DOUBLE) AS score FROM specials
  UNION ALL
  SELECT CAST(7 + b AS INTEGER), '<0x' || printf('%02X', b) || '>', 'BYTE', CAST(0 AS DOUBLE) FROM range(256) t(b)
  UNION ALL
  SELECT id, '▁' || word, 'NORMAL', ln(cnt / (SELECT count(*) FROM w)) FROM vocab
)
"""

ORACLE["e_special"] = _q(CTE_WORDS, CTE_VOCAB, CTE_PIECES, body="SELECT id, piece, type, round(score, 6) AS score FROM pt")

ORACLE["e_stats"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(),
    body="SELECT count(*) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS total_tokens, round(avg(len(ids)), 6) AS mean_tokens FROM enc",
)

# --------------------------------------------------------------------------- F

ORACLE["f_single"] = _q(*CTE_BENC, body="SELECT item_id, array_to_string([1] || ids || [2], ' ') AS ids FROM benc")

CTE_MSG = "msg AS (SELECT conv_id * 1000000 + turn AS mid, conv_id, turn, role, text FROM conversations)"
ORACLE["f_pair"] = _q(
    CTE_WORDS, CTE_VOCAB, CTE_MSG, words_of("msg", "mid", "text", "mw"), cte_encode("mw", "mid", "menc"),
    """
me AS (SELECT m.conv_id, m.turn, m.role, e.ids FROM menc e JOIN msg m USING (mid))
""",
    body="""
SELECT a.conv_id, a.turn,
       array_to_string([1] || a.ids || [2] || b.ids || [2], ' ') AS ids,
       array_to_string(list_transform(range(len(a.ids) + 2), lambda x: 0) || list_transform(range(len(b.ids) + 1), lambda x: 1), ' ') AS type_ids
FROM me a JOIN me b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user'
""",
)

ORACLE["f_truncate"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(),
    body=f"SELECT doc_id, array_to_string([1] || ids[1:{S - 2}] || [2], ' ') AS ids FROM enc",
)

ORACLE["f_decode"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_PIECES,
    """
hx AS (
  SELECT id AS tid, CASE WHEN type = 'BYTE' THEN substr(piece, 4, 2) ELSE hex(encode(piece)) END AS h
  FROM pt WHERE id NOT IN (0, 1, 2, 3, 4)
),
dt AS (SELECT doc_id, unnest(ids) AS tid, unnest(range(len(ids))) AS p FROM enc),
dj AS (SELECT dt.doc_id, replace(decode(unhex(string_agg(hx.h, '' ORDER BY dt.p))), '▁', ' ') AS raw
       FROM dt JOIN hx USING (tid) GROUP BY dt.doc_id),
dd AS (SELECT doc_id, CASE WHEN starts_with(raw, ' ') THEN substr(raw, 2) ELSE raw END AS text FROM dj)
""",
    body="SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM dd",
)

ORACLE["f_pad_choice"] = _q(
    CTE_WORDS, CTE_VOCAB, CTE_PIECES,
    body="""
SELECT CAST(coalesce(max(CASE WHEN piece = '<pad>' THEN id END), max(CASE WHEN piece = '</s>' THEN id END),
                max(CASE WHEN piece = '<unk>' THEN id END)) AS INTEGER) AS pad_id FROM pt
""",
)

ORACLE["f_chat"] = _q(
    CTE_WORDS, CTE_VOCAB,
    """
chats AS (
  SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat
  FROM conversations GROUP BY conv_id
)
""",
    words_of("chats", "conv_id", "chat", "cw"), cte_encode("cw", "conv_id", "cenc"),
    body="""
SELECT c.conv_id, md5(c.chat) AS chat_md5, CAST(length(c.chat) AS INTEGER) AS n_chars, CAST(len(e.ids) AS INTEGER) AS n_ids
FROM chats c JOIN cenc e USING (conv_id)
""",
)


# --------------------------------------------------------------------------- G / H

ORACLE["g_pack_tail"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM,
    f"""
tails AS (
  SELECT shard, nb, list(t ORDER BY p) AS tt FROM tokb WHERE p >= nb * {S}
  GROUP BY shard, nb, tot HAVING tot - nb * {S} > 1
)
""",
    body=f"""
SELECT shard, CAST(nb AS BIGINT) AS block_id,
  array_to_string(tt || list_transform(range({S} - len(tt)), lambda x: 3), ' ') AS input_ids,
  array_to_string(tt[2:] || list_transform(range({S} - len(tt) + 1), lambda x: -100), ' ') AS labels,
  array_to_string(list_transform(range(len(tt)), lambda x: 1) || list_transform(range({S} - len(tt)), lambda x: 0), ' ') AS attention_mask
FROM tails
""",
)

ORACLE["g_batches"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM, CTE_BLOCKS,
    f"steps AS (SELECT shard, CAST(count(*) // {P.BATCH_SIZE} AS BIGINT) AS total_steps FROM blocks GROUP BY shard)",
    body=f"""
SELECT b.shard, CAST(b.block_id // {P.BATCH_SIZE} AS BIGINT) AS batch_id, count(*) AS n_samples, s.total_steps
FROM blocks b JOIN steps s USING (shard) GROUP BY b.shard, b.block_id // {P.BATCH_SIZE}, s.total_steps
""",
)

CTE_COLLATE = """
col AS (SELECT item_id, batch_id, ids, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch_id) AS m FROM ev),
colp AS (
  SELECT item_id, batch_id,
         ids || list_transform(range(m - n), lambda x: 3) AS input_ids,
         list_transform(range(n), lambda x: 1) || list_transform(range(m - n), lambda x: 0) AS attention_mask,
         list_transform(ids || list_transform(range(m - n), lambda x: 3), lambda x: CASE WHEN x = 3 THEN -100 ELSE x END) AS labels
  FROM col
)
"""

ORACLE["g_collate"] = "WITH " + CTE_EVAL.rstrip() + ",\n" + CTE_COLLATE.strip() + """
SELECT item_id, batch_id, array_to_string(input_ids, ' ') AS input_ids,
       array_to_string(attention_mask, ' ') AS attention_mask, array_to_string(labels, ' ') AS labels FROM colp
"""

ORACLE["g_shift"] = "WITH " + CTE_EVAL.rstrip() + ",\n" + CTE_COLLATE.strip() + """
SELECT item_id, batch_id, array_to_string(labels[2:], ' ') AS labels,
       CAST(len(list_filter(labels[2:], lambda x: x <> -100)) AS INTEGER) AS n_valid FROM colp
"""

_ALPHA = _dbl(P.ALPHA)
_ALPHA_V = _dbl(P.ALPHA * (263 + P.VOCAB_SIZE))
CTE_MODEL = f"""
seqs AS (SELECT doc_id, [2] || ids || [2] AS s FROM enc),
bpairs AS (SELECT s[i] AS a, s[i + 1] AS b FROM (SELECT s, unnest(range(1, len(s))) AS i FROM seqs) t),
model AS (SELECT a, b, count(*) AS cnt FROM bpairs GROUP BY a, b),
ctot AS (SELECT a, sum(cnt) AS ca FROM model GROUP BY a)
"""

ORACLE["h_bigram"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_MODEL,
    body=f"""
SELECT m.a, m.b, m.cnt, round(ln((m.cnt + {_ALPHA}) / (c.ca + {_ALPHA_V})), 6) AS logp
FROM model m JOIN ctot c USING (a)
""",
)

CTE_SCORES = CTE_EVAL.rstrip() + ",\n" + CTE_COLLATE.strip() + ",\n" + ",\n".join(
    c.strip() for c in (cte_encode(), CTE_MODEL)
) + f""",
ep AS (
  SELECT batch_id, input_ids[i] AS a, labels[i + 1] AS b
  FROM (SELECT batch_id, input_ids, labels, unnest(range(1, len(input_ids))) AS i FROM colp) t
  WHERE labels[i + 1] <> -100
),
bsc AS (
  SELECT ep.batch_id, sum(-ln((coalesce(m.cnt, 0) + {_ALPHA}) / (coalesce(c.ca, 0) + {_ALPHA_V}))) AS nll, count(*) AS n_tokens
  FROM ep LEFT JOIN model m ON m.a = ep.a AND m.b = ep.b LEFT JOIN ctot c ON c.a = ep.a
  GROUP BY ep.batch_id
)
"""
# the eval CTE already defines wl/w/vocab; the document encoder adds enc

ORACLE["h_batch_loss"] = "WITH " + CTE_SCORES + "SELECT batch_id, round(nll / n_tokens, 6) AS loss FROM bsc"

ORACLE["h_update_loss"] = "WITH " + CTE_SCORES + f"""
SELECT CAST(batch_id // {P.ACCUMULATE} AS BIGINT) AS update_id, round(avg(nll / n_tokens), 6) AS loss
FROM bsc GROUP BY batch_id // {P.ACCUMULATE} HAVING count(*) = {P.ACCUMULATE}
"""

ORACLE["h_logppl"] = "WITH " + CTE_SCORES + f"""
, t AS (
  SELECT sum(nll) AS nll, sum(n_tokens) AS n,
         sum(CASE WHEN batch_id = 0 THEN nll END) AS nll0, sum(CASE WHEN batch_id = 0 THEN n_tokens END) AS n0
  FROM bsc WHERE batch_id < {P.MAX_EVAL_BATCHES}
)
SELECT round(CASE WHEN coalesce(n, 0) > 0 THEN nll / n ELSE -100 END, 6) AS log_ppl,
       round(CASE WHEN coalesce(n0, 0) > 0 THEN nll0 / n0 ELSE -100 END, 6) AS const_log_ppl,
       CAST(coalesce(n, 0) AS BIGINT) AS n_valid
FROM t
"""

ORACLE["a_metric_long"] = "WITH " + CTE_SCORES + """
SELECT batch_id AS step, 'Loss/Validation' AS tag, round(nll / n_tokens, 6) AS value FROM bsc
UNION ALL
SELECT batch_id, 'Tokens/Validation', round(CAST(n_tokens AS DOUBLE), 6) FROM bsc
"""

ORACLE["h_best"] = """
SELECT tag, step, value, (v IS NOT NULL AND (pm IS NULL OR v < pm)) AS is_best FROM (
  SELECT tag, step, value, v,
         min(v) OVER (PARTITION BY tag ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
  FROM (SELECT event_type AS tag, event_id AS step, value,
               CASE WHEN value <> -100 AND NOT isnan(value) THEN value END AS v FROM events) e) t
"""

ORACLE["h_log"] = f"""
SELECT event_id AS step, 'Loss/Train' AS tag, round(value, 6) AS value FROM events
UNION ALL
SELECT step, 'Loss/Validation', round(value, 6) FROM (
  SELECT (event_id // {P.CHECKPOINT_INTERVAL} + 1) * {P.CHECKPOINT_INTERVAL} - 1 AS step, avg(value) AS value, max(event_id) AS last
  FROM events GROUP BY 1) t WHERE step = last
"""

ORACLE["a_metric_append"] = f"""
SELECT 'a' AS run, event_id AS step, 'Loss/Train' AS tag, round(value, 6) AS value FROM events
UNION ALL SELECT 'a', event_id, 'Learning Rate', round(value / 1000, 6) FROM events
UNION ALL SELECT 'b', event_id, 'Loss/ConstEval', round(value, 6) FROM events WHERE (event_id + 1) % {P.CHECKPOINT_INTERVAL} = 0
"""


# --------------------------------------------------------------------------- I

ORACLE["i_scores"] = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
),
c AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v) + 1e-6) AS rms FROM v),
sc AS (SELECT c.vec_id AS ctx_id, i.vec_id AS item_id, list_dot_product(c.v, i.v) / c.rms AS score FROM c, v i),
r AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY score DESC, item_id ASC) AS rk FROM sc)
SELECT ctx_id, CAST(rk AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM r WHERE rk <= {P.SCORE_TOP_K}
"""

_PEN = _dbl(P.PENALTY)
CTE_CANDS = ",\n".join(
    c.strip() for c in (CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_MODEL, words_of("benchmark", "item_id", "text", "bw"), cte_encode("bw", "item_id", "benc"))
) + f""",
prompts AS (SELECT item_id AS ctx_id, [2] || ids AS ids FROM benc),
lastt AS (SELECT ctx_id, ids[greatest(len(ids) - {P.CROP - 1}, 1):][-1] AS a FROM prompts),
seen AS (SELECT DISTINCT ctx_id, unnest(ids) AS token_id FROM prompts),
pairs AS (SELECT l.ctx_id, m.b AS token_id, m.cnt FROM lastt l JOIN model m ON m.a = l.a),
raw AS (
  SELECT l.ctx_id, CAST(t.id AS INTEGER) AS token_id, p.cnt IS NOT NULL OR s.token_id IS NOT NULL AS own, s.token_id IS NOT NULL AS was_seen,
         ln((coalesce(p.cnt, 0) + {_ALPHA}) / (coalesce(c.ca, 0) + {_ALPHA_V})) AS logit
  FROM lastt l CROSS JOIN range({263 + V}) t(id) LEFT JOIN ctot c ON c.a = l.a
  LEFT JOIN pairs p ON p.ctx_id = l.ctx_id AND p.token_id = t.id LEFT JOIN seen s ON s.ctx_id = l.ctx_id AND s.token_id = t.id
),
cands AS (
  SELECT ctx_id, token_id, own, CASE WHEN NOT was_seen THEN logit WHEN logit < 0 THEN logit * {_PEN} ELSE logit / {_PEN} END AS logit FROM raw
),
tk AS (
  SELECT ctx_id, token_id, own, logit FROM (
    SELECT ctx_id, token_id, own, logit / {_dbl(P.TEMPERATURE)} AS logit,
           rank() OVER (PARTITION BY ctx_id ORDER BY logit / {_dbl(P.TEMPERATURE)} DESC) AS r FROM cands) t
  WHERE r <= {P.TOP_K}
),
sm AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY ctx_id)) AS e FROM tk),
sm2 AS (SELECT ctx_id, token_id, own, logit, e / sum(e) OVER (PARTITION BY ctx_id) AS p FROM sm),
tp AS (
  SELECT ctx_id, token_id, own, logit FROM (
    SELECT *, sum(p) OVER (PARTITION BY ctx_id ORDER BY logit DESC, own DESC, token_id ASC
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sm2) t
  WHERE before IS NULL OR before <= {_dbl(P.TOP_P)}
),
tpe AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY ctx_id)) AS e FROM tp),
probs AS (SELECT ctx_id, token_id, own, e / sum(e) OVER (PARTITION BY ctx_id) AS prob FROM tpe)
"""


def _folded(src: str, value: str) -> str:
    """Rows of the pieces with a logit of their own; one row (token_id null, n) for the others of a context."""
    return f"""
SELECT ctx_id, token_id, CAST(1 AS BIGINT) AS n, round({value}, 6) AS {value} FROM {src} WHERE own
UNION ALL
SELECT ctx_id, CAST(NULL AS INTEGER), count(*), round(max({value}), 6) FROM {src} WHERE NOT own GROUP BY ctx_id
"""


ORACLE["i_penalty"] = "WITH " + CTE_CANDS + _folded("cands", "logit")
ORACLE["i_greedy"] = "WITH " + CTE_CANDS + """
SELECT ctx_id, token_id FROM (
  SELECT ctx_id, token_id, row_number() OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id ASC) AS r FROM cands) t
WHERE r = 1
"""
ORACLE["i_topk"] = "WITH " + CTE_CANDS + _folded("tk", "logit")
ORACLE["i_topp"] = "WITH " + CTE_CANDS + _folded("probs", "prob")
ORACLE["i_draw"] = "WITH " + CTE_CANDS + f"""
, cdf AS (
  SELECT ctx_id, token_id,
         sum(prob) OVER (PARTITION BY ctx_id ORDER BY token_id ROWS UNBOUNDED PRECEDING) AS c,
         CAST(('0x' || substr(md5('{P.SEED}:' || CAST(ctx_id AS VARCHAR)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM probs
)
SELECT ctx_id, coalesce(min(CASE WHEN c > u THEN token_id END), max(token_id)) AS token_id FROM cdf GROUP BY ctx_id
"""

ORACLE["i_eos"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM, CTE_BLOCKS,
    f"""
bl AS (
  SELECT shard, block_id, list_transform(string_split(input_ids, ' '), lambda x: CAST(x AS INTEGER)) AS ids FROM blocks
),
fe AS (SELECT shard, block_id, ids, list_position(ids, 2) AS f FROM bl)
""",
    body=f"""
SELECT shard, block_id,
       array_to_string(CASE WHEN f IS NOT NULL THEN ids[1:f] || list_transform(range(len(ids) - f), lambda x: 2) ELSE ids END, ' ') AS ids,
       CAST(max(CASE WHEN f IS NOT NULL THEN f ELSE len(ids) END) OVER (PARTITION BY shard, block_id // {P.BATCH_SIZE}) AS INTEGER) AS batch_len
FROM fe
""",
)


# --------------------------------------------------------------------------- loader chain

ORACLE["g_loader"] = (
    "WITH "
    + cte_mix(P.MIX_PRESET, P.SEED, "all_exhausted").strip()
    + ",\n"
    + ",\n".join(c.strip() for c in (CTE_WORDS.replace("FROM documents WHERE", "FROM documents WHERE"), CTE_VOCAB, cte_encode()))
    + f""",
mpos AS (SELECT doc_id, row_number() OVER (ORDER BY k) - 1 AS pos0 FROM mixed),
"""
    + cte_buffer("mpos", "lpos").strip()
    + """,
"""
    + cte_shards("lpos", W).strip()
    + ",\n"
    + CTE_PACK_STREAM.strip()
    + ",\n"
    + CTE_BLOCKS.strip()
    + f"""
SELECT shard, CAST(block_id // {P.BATCH_SIZE} AS BIGINT) AS batch_id, block_id, input_ids, labels FROM blocks
"""
)


# --------------------------------------------------------------------------- reports

ORACLE["d_limit_global"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM,
    body=f"""
SELECT doc_id, stream_pos FROM (SELECT doc_id, row_number() OVER (ORDER BY pos) - 1 AS stream_pos FROM st) t
WHERE stream_pos < {P.MAX_SAMPLES}
""",
)

ORACLE["g_tail_report"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM,
    body=f"""
SELECT shard, CAST(tot AS BIGINT) AS tokens, CAST(tot - greatest((tot - 1) // {S}, 0) * {S} AS BIGINT) AS dropped
FROM (SELECT DISTINCT shard, tot FROM st_off) t
""",
)

ORACLE["c_shares"] = (
    "WITH "
    + cte_mix(P.MIX_PRESET, P.SEED, "all_exhausted").strip()
    + ",\n"
    + ",\n".join(c.strip() for c in (CTE_WORDS, CTE_VOCAB, cte_encode()))
    + """,
per AS (
  SELECT m.genre, count(*) AS n_docs, CAST(sum(coalesce(len(e.ids), 0)) AS BIGINT) AS n_tokens
  FROM mixed m JOIN enc e USING (doc_id) GROUP BY m.genre
)
SELECT genre, n_docs, n_tokens,
       round(n_docs / (SELECT sum(n_docs) FROM per), 6) AS doc_share,
       round(n_tokens / (SELECT sum(n_tokens) FROM per), 6) AS token_share
FROM per
"""
)


# --------------------------------------------------------------------------- streams: the batch twins

ORACLE["a_stream"] = "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents"
ORACLE["j_pack"] = ORACLE["g_pack"]  # the stream with arrival order = doc_id order equals the batch packer
ORACLE["j_metrics"] = ORACLE["h_best"]


# --------------------------------------------------------------------------- full pair-merge run


def _bpe_table_sql(n: int) -> str:
    """Alphabet of ``▁word`` (weighted by word counts) plus n unrolled merges."""
    merges = _merges_sql(n)
    head, tail = merges.split("\nSELECT CAST(0 AS INTEGER)", 1)
    merge_rows = "SELECT CAST(0 AS INTEGER)" + tail
    return head + f""",
wcount AS (SELECT word, count(*) AS freq FROM w WHERE word NOT IN ('<pad>', '<mask>', '<|im_start|>', '<|im_end|>') GROUP BY word),
bcc AS (
  SELECT ch, CAST(sum(freq) AS BIGINT) AS cnt
  FROM (SELECT unnest(regexp_extract_all('▁' || word, '(?s).')) AS ch, freq FROM wcount) t
  WHERE ch <> '' GROUP BY ch
),
bcr AS (
  SELECT ch, cnt,
         coalesce(sum(cnt) OVER (ORDER BY cnt DESC, ch ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(cnt) OVER () AS total, row_number() OVER (ORDER BY cnt DESC, ch ASC) AS rk
  FROM bcc
),
alpha AS (SELECT ch AS piece, rk FROM bcr WHERE before * 1000000 < total * {_COV}),
mrg AS ({merge_rows}),
mk AS (
  SELECT merge_idx, l || r AS piece, row_number() OVER (PARTITION BY l || r ORDER BY merge_idx) AS first
  FROM mrg WHERE l || r NOT IN (SELECT piece FROM alpha)
),
learned AS (
  SELECT CAST(262 + rk AS INTEGER) AS id, piece, CAST(0 AS DOUBLE) AS score FROM alpha
  UNION ALL
  SELECT CAST(262 + (SELECT count(*) FROM alpha) + row_number() OVER (ORDER BY merge_idx) AS INTEGER),
         piece, -CAST(merge_idx + 1 AS DOUBLE)
  FROM mk WHERE first = 1
),
specials(id, piece, type) AS (VALUES {_SPECIAL_ROWS})
SELECT CAST(id AS INTEGER) AS id, piece, CAST(0 AS DOUBLE) AS score, type FROM specials
UNION ALL
SELECT CAST(7 + b AS INTEGER), '<0x' || printf('%02X', b) || '>', CAST(0 AS DOUBLE), 'BYTE' FROM range(256) t(b)
UNION ALL
SELECT id, piece, score, 'NORMAL' FROM learned
"""


ORACLE["e_bpe"] = _bpe_table_sql(P.BPE_FULL_MERGES)


# --------------------------------------------------------------------------- sinks: counts read back

ORACLE["a_sinks"] = (
    "WITH "
    + cte_mix(P.MIX_PRESET, P.SEED, "all_exhausted").strip()
    + ",\n"
    + ",\n".join(c.strip() for c in (CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM, CTE_BLOCKS))
    + f""",
shm AS (
  SELECT doc_id, text,
         row_number() OVER (ORDER BY md5('{P.SEED}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)), doc_id, k) - 1 AS pos
  FROM mixed WHERE text IS NOT NULL
),
cb AS (
  SELECT pos, text,
         sum(octet_length(encode({_BROKEN} || chr(10)))) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum
  FROM shm WHERE pos < {P.MAX_DOCUMENTS}
),
cstop AS (SELECT min(pos) AS s FROM cb WHERE pos % {P.BYTE_CHECK_EVERY} = 0 AND cum >= {P.MAX_BYTES}),
kept AS (SELECT text FROM cb, cstop WHERE cstop.s IS NULL OR cb.pos <= cstop.s),
specials(id, piece, type) AS (VALUES {_SPECIAL_ROWS}),
sunk AS (
  SELECT 'corpus_lines' AS sink, unnest(string_split({_BROKEN}, chr(10))) AS row FROM kept
  UNION ALL
  SELECT 'blocks', concat_ws('|', shard, block_id, input_ids, labels) FROM blocks
  UNION ALL
  SELECT 'pieces', concat_ws('|', id, piece, type) FROM (
    SELECT id, piece, type FROM specials
    UNION ALL SELECT 7 + b, '<0x' || printf('%02X', b) || '>', 'BYTE' FROM range(256) t(b)
    UNION ALL SELECT id, '▁' || word, 'NORMAL' FROM vocab) p
)
SELECT sink, count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(row), 1, 13)) AS HUGEINT)) AS VARCHAR) AS content
FROM sunk GROUP BY sink
"""
)


# --------------------------------------------------------------------------- loader options, streaming limit, checks

ORACLE["j_pack_limit"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(),
    "dpos AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)",
    cte_shards("dpos", W),
    f"""
st AS (
  SELECT shard, pos, doc_id, toks FROM (
    SELECT d.shard, d.pos, d.doc_id, e.ids || [2] AS toks, row_number() OVER (PARTITION BY d.shard ORDER BY d.pos) AS r
    FROM dshard d JOIN enc e USING (doc_id) WHERE len(e.ids) > 0) t WHERE r <= {P.MAX_SAMPLES}
)
""",
    body=f"""
, off AS (SELECT shard, toks, sum(len(toks)) OVER (PARTITION BY shard ORDER BY pos ROWS UNBOUNDED PRECEDING) - len(toks) AS start FROM st),
tok AS (SELECT shard, CAST(start + unnest(range(len(toks))) AS BIGINT) AS p, unnest(toks) AS t FROM off),
seq AS (SELECT shard, list(t ORDER BY p) AS s FROM tok GROUP BY shard),
blk AS (SELECT shard, s, unnest(range((len(s) - 2) // {S} + 1)) AS b FROM seq WHERE len(s) > 1),
cut AS (SELECT shard, b, s[b * {S} + 1 : b * {S} + {S}] AS i, s[b * {S} + 2 : b * {S} + {S} + 1] AS l FROM blk)
SELECT shard, CAST(b AS BIGINT) AS block_id,
       array_to_string(i || list_transform(range({S} - len(i)), lambda x: 3), ' ') AS input_ids,
       array_to_string(l || list_transform(range({S} - len(l)), lambda x: -100), ' ') AS labels,
       array_to_string(list_transform(range({S}), lambda x: CASE WHEN x < len(i) THEN 1 ELSE 0 END), ' ') AS attention_mask
FROM cut
""",
)

_SINGLE = R.GENRES.index(P.SINGLE_GENRE)
ORACLE["g_loader_tail"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(),
    f"""dpos AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n
      FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 6 = {_SINGLE} AND text IS NOT NULL)""",
    cte_shards("dpos", 2),
    f"""
st AS (
  SELECT shard, pos, toks FROM (
    SELECT d.shard, d.pos, e.ids AS toks, row_number() OVER (PARTITION BY d.shard ORDER BY d.pos) AS r
    FROM dshard d JOIN enc e USING (doc_id) WHERE len(e.ids) > 0) t WHERE r <= {P.LOADER_SAMPLES}
)
""",
    body=f"""
, off AS (SELECT shard, toks, sum(len(toks)) OVER (PARTITION BY shard ORDER BY pos ROWS UNBOUNDED PRECEDING) - len(toks) AS start FROM st),
tok AS (SELECT shard, CAST(start + unnest(range(len(toks))) AS BIGINT) AS p, unnest(toks) AS t FROM off),
seq AS (SELECT shard, list(t ORDER BY p) AS s FROM tok GROUP BY shard),
blk AS (SELECT shard, s, unnest(range((len(s) - 2) // {S} + 1)) AS b FROM seq WHERE len(s) > 1),
cut AS (SELECT shard, b, s[b * {S} + 1 : b * {S} + {S}] AS i, s[b * {S} + 2 : b * {S} + {S} + 1] AS l FROM blk),
bat AS (SELECT *, b // {P.BATCH_SIZE} AS batch_id, count(*) OVER (PARTITION BY shard, b // {P.BATCH_SIZE}) AS k FROM cut)
SELECT shard, CAST(batch_id AS BIGINT) AS batch_id, CAST(b AS BIGINT) AS block_id,
       array_to_string(i || list_transform(range({S} - len(i)), lambda x: 3), ' ') AS input_ids,
       array_to_string(l || list_transform(range({S} - len(l)), lambda x: -100), ' ') AS labels
FROM bat WHERE k = {P.BATCH_SIZE}
""",
)

ORACLE["c_choice"] = f"""
WITH n AS (SELECT CAST(substr(source, 4) AS INTEGER) % 6 AS g, count(*) AS c FROM documents GROUP BY 1),
t AS (SELECT min(c) AS low, sum(c) AS total FROM n)
SELECT 'shares' AS case, CAST(0 AS INTEGER) AS problems
UNION ALL SELECT 'doubled', 1
UNION ALL SELECT 'unknown genre', 2
UNION ALL SELECT 'without documents', 2
UNION ALL SELECT 'vocabulary', CAST(low < 100 AS INTEGER) FROM t
UNION ALL SELECT 'all wrong', CAST(low - total < 100 AS INTEGER) + CAST(1 + low > 1 AS INTEGER) + 2 FROM t
"""

ORACLE["e_unigram_summary"] = _q(
    CTE_WORDS,
    f"""
wcount AS (SELECT word, count(*) AS freq FROM w WHERE word NOT IN ('<pad>', '<mask>', '<|im_start|>', '<|im_end|>') GROUP BY word),
cc AS (
  SELECT ch, sum(freq) AS cnt FROM (SELECT unnest(regexp_extract_all('▁' || word, '(?s).')) AS ch, freq FROM wcount) t
  WHERE ch <> '' GROUP BY ch
),
cr AS (
  SELECT ch, coalesce(sum(cnt) OVER (ORDER BY cnt DESC, ch ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(cnt) OVER () AS total FROM cc
)
""",
    body=f"""
SELECT CAST({263 + P.UNIGRAM_VOCAB} AS BIGINT) AS n_pieces, CAST(1 AS DOUBLE) AS mass,
       count(*) AS n_characters FROM cr WHERE before * 1000000 < total * {_COV}
""",
)

ORACLE["f_subword_text"] = _q(
    CTE_WORDS,
    body="SELECT doc_id, md5(array_to_string(ws, ' ')) AS text_md5 FROM wl WHERE len(ws) > 0",
)

ORACLE["f_bpe_text"] = ORACLE["f_subword_text"]

ORACLE["h_samples"] = f"""
SELECT event_id AS step, 'Sample/' || item_id AS tag, substr(text, 1, 100) AS text
FROM events, benchmark WHERE item_id < 2 AND (event_id + 1) % {P.CHECKPOINT_INTERVAL} = 0
"""

ORACLE["a_block_order"] = _q(
    CTE_WORDS, CTE_VOCAB, cte_encode(), CTE_STREAM, CTE_BLOCKS,
    body="""
SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY block_id) - 1 AS place, block_id, md5(input_ids) AS ids_md5 FROM blocks
""",
)
