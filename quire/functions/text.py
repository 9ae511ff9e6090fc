"""Column expressions for text: word split, sentence break, normalisation, hashing.

Everything here returns a ``Column`` built from built-in functions so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's tokenizer settings)
# ---------------------------------------------------------------------------
# Special pieces and their ids: unk 0, bos 1, eos 2, pad 3, then the
# user-defined symbols in the order the trainer receives them.
UNK_ID, BOS_ID, EOS_ID, PAD_ID, MASK_ID, IM_START_ID, IM_END_ID = 0, 1, 2, 3, 4, 5, 6
SPECIAL_PIECES = [
    (0, "<unk>", "UNKNOWN"),
    (1, "<s>", "CONTROL"),
    (2, "</s>", "CONTROL"),
    (3, "<pad>", "USER_DEFINED"),
    (4, "<mask>", "USER_DEFINED"),
    (5, "<|im_start|>", "USER_DEFINED"),
    (6, "<|im_end|>", "USER_DEFINED"),
]
USER_DEFINED = ["<pad>", "<mask>", "<|im_start|>", "<|im_end|>"]
# Ids skipped by decode(skip_special_tokens=True): bos, eos, unk, pad, mask.
SKIP_ON_DECODE = [0, 1, 2, 3, 4]
BYTE_BASE = 7  # <0x00> .. <0xFF> take ids 7 .. 262
FIRST_LEARNED_ID = BYTE_BASE + 256  # 263
IGNORE_INDEX = -100
WORD_BOUNDARY = "▁"  # the whitespace marker every learned word piece starts with
SENTENCE_TERMINATOR = "。"  # the reference breaks lines after this character
MAX_SENTENCE_BYTES = 4192  # trainer default for the longest input line
CHAT_OPEN, CHAT_CLOSE = "<|im_start|>", "<|im_end|>"

# Whitespace that separates words for the word model.
WHITESPACE_RE = "[ \\t\\n\\r]+"
_SYMBOL_RE = "(" + "|".join(s.replace("|", "\\|") for s in USER_DEFINED) + ")"


def isolate_symbols(text: Column) -> Column:
    """Surround user-defined symbols with spaces so they become words of their own.

    Every symbol starts with ``<``; texts without one skip the regex.
    """
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, _SYMBOL_RE, " $1 ")).otherwise(text)


def words(text: Column) -> Column:
    """array<string> of whitespace-separated words (empty strings removed)."""
    return F.filter(F.split(isolate_symbols(text), WHITESPACE_RE), lambda w: w != "")


def chars(text: Column) -> Column:
    """array<string> of Unicode code points."""
    return F.split(text, "")


def sentence_break(text: Column, terminators: list[str] | tuple[str, ...] = (SENTENCE_TERMINATOR,)) -> Column:
    """Newline after every terminator, plus one final newline (the corpus line form)."""
    out = text
    for t in terminators:
        out = F.replace(out, F.lit(t), F.lit(t + "\n"))
    return F.concat(out, F.lit("\n"))


def utf8_byte_ids(s: Column) -> Column:
    """array<int> of byte-fallback ids, one per UTF-8 byte of ``s``."""
    pairs = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("[0-9A-F]{2}"), 0)
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int") + F.lit(BYTE_BASE))


def collapse_whitespace(text: Column) -> Column:
    """Trim and collapse runs of whitespace to one space (extra-whitespace removal)."""
    return F.trim(F.regexp_replace(text, WHITESPACE_RE, " "))


# The custom normalisation table used by the tests (source -> target).
CUSTOM_RULES = [("«", '"'), ("»", '"'), ("…", "..."), ("’", "'")]


def rule_table(rules) -> dict[str, str]:
    """source -> target; the first rule of a source counts, an empty source is no rule."""
    table: dict[str, str] = {}
    for src, tgt in rules:
        if src:
            table.setdefault(src, tgt)
    return table


def prefix_pattern(sources) -> str:
    """Regular expression of a prefix automaton over ``sources``: it matches the longest source at the leftmost place."""
    tree: dict = {}
    for s in sources:
        at = tree
        for ch in s:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [f"\\x{{{ord(ch):x}}}" + pattern(at[ch]) for ch in sorted(at) if ch]
        if not ways:
            return ""
        inner = ways[0] if len(ways) == 1 and "" not in at else "(?:" + "|".join(ways) + ")"
        return inner + "?" if "" in at else inner

    return pattern(tree)


OPEN_MARK, CLOSE_MARK = "\ufdd0", "\ufdd1"  # non-characters: no text holds them


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Source -> target rewriting in one pass: the longest source at the leftmost place, and no
    target is rewritten again. Matches are marked first; a marked source is then its target.

    A pass per rule over the marked text, inside code generation: for rule tables of some dozen
    entries (:func:`quire.operators.clean.rewrite` takes any number).
    """
    table = rule_table(rules)
    if not table:
        return text
    out = F.regexp_replace(text, prefix_pattern(table), OPEN_MARK + "$0" + CLOSE_MARK)
    for src, tgt in table.items():
        out = F.replace(out, F.lit(OPEN_MARK + src + CLOSE_MARK), F.lit(tgt))
    return out


def escape_whitespace(text: Column, dummy_prefix: bool = True) -> Column:
    """Replace spaces with the boundary marker; optionally add the dummy prefix."""
    body = F.replace(text, F.lit(" "), F.lit(WORD_BOUNDARY))
    if dummy_prefix:
        body = F.when(F.length(text) > 0, F.concat(F.lit(WORD_BOUNDARY), body)).otherwise(body)
    return body


def uniform01(seed: int, *keys: Column | str) -> Column:
    """Deterministic u in [0, 1): the first 13 hex digits of md5(seed:key:...) / 2^52."""
    parts: list[Column] = [F.lit(str(seed))]
    for k in keys:
        parts.append(F.lit(":"))
        parts.append(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"))
    h = F.md5(F.concat(*parts))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def hash_key(seed: int, *keys: Column | str) -> Column:
    """md5 hex of seed:key:... — a uniformly spread, deterministic order key."""
    parts: list[Column] = [F.lit(str(seed))]
    for k in keys:
        parts.append(F.lit(":"))
        parts.append(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"))
    return F.md5(F.concat(*parts))


def ids_text(ids: Column) -> Column:
    """Space-joined decimal form of an id array (stable for value hashes)."""
    return F.array_join(ids.cast("array<string>"), " ")
