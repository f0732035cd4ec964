"""Text, hashing and id scalars.  All are built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters that stand for ASCII ones.
FOLD_FROM = "‐‑‒–—―−‘’‛′`“”‟″  "
FOLD_TO = "-------'''''\"\"\"\"  "
# Characters that stand for several.
FOLD_WIDE = {"…": "...", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}
# Names of model output channels, their markers, how a reply without markers begins, a marker in general.
CHANNELS = "analysis|final|commentary"
FINAL_TAG, FINAL_WORD = "<|channel|>final<|message|>", "assistantfinal"
WELDED = r"^(analysis|commentary)(?=\S)"
TAG = r"<\|[^|>]*\|>"
# A judge's named score and any number in its reply.
NAMED_SCORE = r"(?i)SCORE\s*[:=]\s*(\d+(?:\.\d+)?)"
NUMBER = r"(?U)\b(\d+(?:\.\d+)?)\b"
# What the comparison form of an answer takes out: links (their words stay), marks of blocks, of emphasis
# and of citations, ASCII punctuation and articles; and how a citation looks.
LINK = r"\[([^\]]*)\]\([^)]*\)"
BLOCK_MARK = r"(?m)^\s{0,3}(#{1,6}\s+|>\s+|[-*+]\s+|\d+[.)]\s+)"
EMPHASIS = r"(\*\*|__|\*|_|`+|~~)"
CITATIONS, CITATION = r"[\[【]\s*\d+(?:\s*,\s*\d+)*\s*[\]】]", r"[\[【]\s*\d+\s*[\]】]"
PUNCTUATION, ARTICLE = r"[!-/:-@\[-`{-~]", r"(?U)\b(a|an|the)\b"


def hash_id(content: Column, prefix: str) -> Column:
    """``prefix`` and the md5 of the text (null text: null)."""
    return F.concat(F.lit(prefix), F.md5(content))


def packed(i: Column, prefix: str) -> Column:
    """An id as bytes that take half its room: the hash of ``prefix`` and an md5 as 16 bytes, any other id as it is."""
    digest = F.substring(i, len(prefix) + 1, 32)
    regular = F.startswith(i, F.lit(prefix)) & F.rlike(F.substr(i, F.lit(len(prefix) + 1)), F.lit(r"\A[0-9a-f]{32}\z"))
    return F.when(regular, F.concat(F.lit(b"\x00"), F.unhex(digest))).otherwise(F.concat(F.lit(b"\x01"), F.encode(i, "UTF-8")))


def unpacked(b: Column, prefix: str) -> Column:
    """The id that ``packed`` took."""
    rest = F.substring(b, 2, 2147483647)
    return F.when(F.substring(b, 1, 1) == F.lit(b"\x00"), F.concat(F.lit(prefix), F.lower(F.hex(rest)))).otherwise(F.decode(rest, "UTF-8"))


def collapse(text: Column) -> Column:
    """Whitespace runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def fold(text: Column) -> Column:
    """Typographic characters to ASCII."""
    out = F.translate(text, FOLD_FROM, FOLD_TO)
    for a, b in FOLD_WIDE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def preview(text: Column, limit: int = 200) -> Column:
    """At most ``limit`` characters of the collapsed text, cut ones ending in ``...``."""
    one = collapse(text)
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit - 3), F.lit("..."))).otherwise(one)


def titled_text(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("\n"), text)).otherwise(text)


def prefix_query(text: Column, instruction: str) -> Column:
    """Put an instruction before a question unless it is there."""
    return F.when(F.startswith(text, F.lit(instruction)), text).otherwise(F.concat(F.lit(instruction), text))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def word_tokens(text: Column) -> Column:
    """Whitespace-separated tokens (array)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def truncate_tokens(text: Column, n: int) -> Column:
    """The first n whitespace tokens; shorter texts stay as they are."""
    t = word_tokens(text)
    return F.when(F.size(t) > n, F.array_join(F.slice(t, 1, n), " ")).otherwise(text)


def truncate_chars(text: Column, n_tokens: int) -> Column:
    """Without a tokenizer: 2.5 characters a token, 64 at least."""
    return F.substring(text, 1, max(int(2.5 * n_tokens), 64))


def defang(text: Column) -> Column:
    """Fence markers inside untrusted text lose their meaning."""
    return F.replace(F.replace(text, F.lit("<<<"), F.lit("< < <")), F.lit(">>>"), F.lit("> > >"))


def json_object(text: Column) -> Column:
    """The JSON object in a model's reply as a string: fenced block, else outermost braces, else ``{}``."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.try_parse_json(c).isNotNull() & (c != "")
    return F.when(ok(fenced), fenced).when(ok(braces), braces).otherwise(F.lit("{}"))


def strip_channels(text: Column) -> Column:
    """Drop ``<|...|>`` tags and the channel names that follow them."""
    bare = F.regexp_replace(F.regexp_replace(text, rf"(?U)(^|{TAG})({CHANNELS})\b\s*", ""), TAG, "")
    return F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")


def final_channel(text: Column) -> Column:
    """What a reply says in its first final channel, blanks included.

    Without markers that is all after the first final word.  A reply that opens
    a channel but has no final one loses its markers and channel names; one
    without channels stays as it is.
    """
    past = lambda mark: F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
    welded = F.rlike(text, F.lit(WELDED))
    return (
        F.when(F.contains(text, F.lit(FINAL_TAG)), F.substring_index(past(FINAL_TAG), "<|", 1))
        .when(F.contains(text, F.lit("<|")), strip_channels(text))
        .when(welded & F.contains(text, F.lit(FINAL_WORD)), past(FINAL_WORD))
        .when(welded, strip_channels(text))
        .otherwise(text)
    )


def parse_score(text: Column) -> Column:
    """``SCORE: n``, 10 at most, else the first number that stands alone and is at most 10, else null."""
    named = F.regexp_extract(text, NAMED_SCORE, 1).try_cast("double")
    alone = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda x: x.try_cast("double"))
    return F.coalesce(F.least(named, F.when(named.isNotNull(), F.lit(10.0))), F.get(F.filter(alone, lambda x: x <= 10), F.lit(0)))


def has_citation(text: Column) -> Column:
    return F.rlike(text, F.lit(CITATION))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalise_answer(text: Column, folded: bool = False) -> Column:
    """Comparison form of an answer.

    Typography folded, Markdown and citation marks stripped, lower case, ASCII
    punctuation to blanks, articles dropped, whitespace collapsed.  With
    ``folded`` the text comes from ``canonical.compatible``, which folds it and
    takes its compatibility form, as Spark's own functions can't.
    """
    t = F.coalesce(text, F.lit("")) if folded else fold_answer(text)
    for pattern, instead in ((LINK, "$1"), (BLOCK_MARK, ""), (EMPHASIS, ""), (CITATIONS, " ")):
        t = F.regexp_replace(t, pattern, instead)
    return collapse(F.regexp_replace(_plain(t), ARTICLE, " "))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), PUNCTUATION, " ")


def fold_answer(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), FOLD_FROM.replace("`", ""), FOLD_TO.replace("'''''", "''''"))
    return F.replace(t, F.lit("…"), F.lit("..."))


def doc_key(text: Column, folded: bool = False) -> Column:
    """Identity form of a document's title: articles stay, punctuation goes; ``folded`` as in ``normalise_answer``."""
    return collapse(_plain(F.coalesce(text, F.lit("")) if folded else fold_answer(text)))


def tokens(text: Column, folded: bool = False) -> Column:
    """Words of the comparison form."""
    return F.filter(F.split(normalise_answer(text, folded), " "), lambda t: t != "")


def expected_fold(text: Column) -> Column:
    """Case- and dash-insensitive form for expected strings (accents: ``canonical.strip_accents``)."""
    return collapse(F.translate(F.lower(text), "‐‑‒–—−", "------"))


def unkern(text: Column) -> tuple[Column, Column]:
    """(text with letter-spaced runs of three or more glued, number of runs)."""
    run = r"(?<!\p{L})(?:\p{L} ){2,}\p{L}(?!\p{L})"
    found = F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1))
    glued = F.aggregate(found, text, lambda t, m: F.replace(t, m, F.replace(m, F.lit(" "), F.lit(""))))
    return glued, F.size(found).cast("long")


def table_markdown(payload: Column) -> Column:
    """A JSON matrix as a pipe table, ragged rows padded; unusable: null."""
    rows = F.filter(F.from_json(F.trim(payload), "array<array<string>>"), lambda r: r.isNotNull())
    width = F.array_max(F.transform(rows, F.size))
    full = F.transform(rows, lambda r: F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    out = F.concat(F.array(line(full[0]), rule), F.transform(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), line))
    return F.when(F.size(rows) > 0, F.array_join(out, "\n"))
