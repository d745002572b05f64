"""Text functions as Column expressions; everything stays in the JVM but :func:`split_jpegs`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The word lists of the three places that drop function words, and the marks of hedging answers.
STOP_ITEMS = "a an the in of at on from is are and or to".split()
STOP_CONFIRM = (
    "a an the and or of in on at to from for with without into onto is are was were be "
    "being been by near next it its that this these those there here as"
).split()
STOP_ANSWER = (
    "a an the this that these those there here and or but if then than so as at by for "
    "from in into of on onto to with without about over under between during it its is "
    "are was were be been being do did does done have has had can could would should "
    "will shall may might must i you he she they we me him her them us my your his their "
    "our what when where which who whom why how did any some all no not yes up down out "
    "off again once more most other same such only own too very s t just now"
).split()
DETAIL_TERMS = (
    "open closed ajar shut colour color read reads reading text sign signage logo brand "
    "plate plates licence license number numbers digit digits label letters writing wrote "
    "face faces expression wearing wore clothing shirt jacket hat mask holding carrying "
    "gesture gesturing exactly precisely detail details clearly zoom close"
).split()
HEDGES = (
    "cannot tell", "can't tell", "cannot determine", "cannot confirm", "not visible", "not clear", "unclear", "unable to",
    "does not show", "doesn't show", "no way to tell", "not enough", "insufficient", "obscured", "too blurry", "i cannot",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lits(words) -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(words)])


def tokenize(c: Column | str) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, in order (F-S1)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def bigrams(c: Column | str) -> Column:
    """``a_b`` of neighbouring words (F-S2)."""
    w = tokenize(c)
    n = F.size(w)
    return F.when(n > 1, F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))


def term_set(c: Column | str, stop=()) -> Column:
    """Distinct words without the stop words (F-S8, F-S9)."""
    w = F.array_distinct(tokenize(c))
    return F.array_except(w, _lits(stop)) if stop else w


def answer_terms(c: Column | str) -> Column:
    """Content words of questions: also without words of one letter (F-S9)."""
    return F.filter(term_set(c, STOP_ANSWER), lambda w: F.length(w) > 1)


def coverage(wanted: Column, seen: Column) -> Column:
    """Share of the wanted words that are seen; 0 if none is wanted (SO4)."""
    return F.when(F.size(wanted) <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wanted, seen)) / F.size(wanted))


def missing_terms(wanted: Column, seen: Column) -> Column:
    """Wanted words that are not seen, sorted (SO5)."""
    return F.array_sort(F.array_except(wanted, seen))


def missing_details(question: Column | str, seen: Column) -> Column:
    """Words of fine visual detail asked for and not seen, sorted (SO5)."""
    return F.array_sort(F.array_except(F.array_intersect(answer_terms(question), _lits(DETAIL_TERMS)), seen))


def hedged(c: Column | str) -> Column:
    """Whether an answer says that it could not see enough (F-S10)."""
    t = F.lower(_col(c))
    out = F.lit(False)
    for h in HEDGES:
        out = out | t.contains(h)
    return F.coalesce(out, F.lit(False))


def yes_no(c: Column | str) -> Column:
    """Whether the first word, without punctuation around it, is yes (F-S12); false for anything else."""
    head = F.regexp_extract(F.lower(_col(c)), r"^\s*(\S+)", 1)
    return F.coalesce(F.regexp_replace(head, r"^[.,:;!\"']+|[.,:;!\"']+$", "") == "yes", F.lit(False))


def clip_text(c: Column | str, most: int) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis (F-S14)."""
    t = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def slugify(c: Column | str) -> Column:
    """Lower-case words joined by hyphens, at most 49 characters (F-S15). Accents of Latin letters are dropped."""
    plain = F.translate(F.lower(_col(c)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    s = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, 49), "-+$", "")


def verdict_label(c: Column | str) -> Column:
    """present or absent of a watch-list answer (F-S16)."""
    return F.when(F.lower(F.trim(_col(c))).isin("present", "yes"), "present").otherwise("absent")


# --- Blocks, verdicts and calls written into prose ---------------------------

# The words of a watch-list verdict, and the marks around an argument of a tool call.
PRESENT_WORDS = ("present", "yes")
ABSENT_WORDS = ("absent", "no", "not present", "not visible")
ARGUMENT_MARK = r"<\|(?:[^|>]{0,4}\|)?>"

_VERDICT = "(" + "|".join(sorted((w.replace(" ", r"\s+") for w in PRESENT_WORDS + ABSENT_WORDS), key=len, reverse=True)) + ")"
#: Prose, header and block of a caption; the first header counts.
BLOCK = r"(?is)^(.*?(?:^|[\s.;]))[\s*#>-]*watching\s*\**\s*:(.*)$"
#: A line that is one item and its verdict.
ITEM_LINE = rf"(?i)^[\s*•\d.)-]*([^:\s](?:[^:]*?[^:\s])?)\s*[:—-]\s*\**{_VERDICT}\**\s*[.,]?\s*$"
#: Items and verdicts that follow one another in a line.
ITEM_RUN = rf"(?i)([^:;]+?)\s*[:—]\s*{_VERDICT}\b"


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


_SPACE = r"[\s\x1c-\x1f]+"


def _plain(c: Column) -> Column:
    """Without white space of any script around it."""
    return F.regexp_replace(c, f"(?U)^{_SPACE}|{_SPACE}$", "")


def _bare(c: Column) -> Column:
    """Without the marks of lists and emphasis around it."""
    return F.regexp_replace(c, r"^[\s*•,;.-]+|[\s*•,;.-]+$", "")


def _last_wins(entries: Column) -> Column:
    """Map of an array of (k, v), a later value of a key replacing an earlier one."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def watch_block(c: Column | str) -> Column:
    """The text after the watch-list header of a caption; empty if it has none."""
    return F.regexp_extract(F.coalesce(_col(c), F.lit("")), BLOCK, 2)


def watch_items(block: Column) -> Column:
    """Item -> present or absent of a watch-list block: a line is one item with its verdict, or else any number of them."""

    def of_line(line: Column) -> Column:
        many = F.arrays_zip(F.transform(_all(line, ITEM_RUN, 1), _bare).alias("k"), _all(line, ITEM_RUN, 2).alias("v"))
        one = F.array(F.struct(F.regexp_replace(F.regexp_extract(line, ITEM_LINE, 1), r"^\*+|\*+$", "").alias("k"), F.regexp_extract(line, ITEM_LINE, 2).alias("v")))
        return F.transform(F.when(line.rlike(ITEM_LINE), one).otherwise(many), lambda e: F.struct(e["k"].alias("k"), F.when(F.lower(e["v"]).isin(*PRESENT_WORDS), "present").otherwise("absent").alias("v")))

    found = F.flatten(F.transform(F.split(block, r"\R"), of_line))
    return _last_wins(F.filter(found, lambda e: e["k"] != ""))


def split_caption(c: Column | str) -> Column:
    """``struct<description, watching>`` of a caption (F-S7). A block without a readable verdict is prose; a null caption is empty."""
    whole = F.coalesce(_col(c), F.lit(""))
    items = watch_items(watch_block(c))
    before = _plain(F.regexp_extract(whole, BLOCK, 1))
    return F.struct(F.when((F.size(items) > 0) & (before != ""), before).otherwise(_plain(whole)).alias("description"), items.alias("watching"))


def grounded_verdict(c: Column | str) -> Column:
    """``struct<grounded, reason>`` of a groundedness answer (F-S11).

    The first line that starts with yes or no, list and emphasis marks aside,
    decides; anything unreadable, and a null, is unknown (null). The reason is
    the rest of that line, or else the next line, or else the whole answer.
    """
    whole = _plain(F.coalesce(_col(c), F.lit("")))
    lines = F.filter(F.split(whole, r"\R"), lambda x: x.rlike(r"[^\s*#-]"))
    decides = r"(?i)^[\s*#-]*(yes|no)"
    first = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(decides), i)), lambda i: i.isNotNull())
    at = F.try_element_at(first, F.lit(1))
    line = F.get(lines, at)
    own = F.regexp_extract(line, decides + r"\b[\s*]*[—:.-]+[\s*]*(\S.*?)\s*$", 2)
    after = F.coalesce(F.trim(F.get(lines, at + 1)), F.lit(""))
    reason = F.when(own != "", own).when(after != "", after).otherwise(whole)
    return F.struct((F.lower(F.regexp_extract(line, decides, 1)) == "yes").alias("grounded"), F.coalesce(reason, whole).alias("reason"))


_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
#: Prose, name and arguments of a call that ends a message: ``name{key:<|>value<|>}`` or ``name(key="value")``.
MARKED_CALL = rf"(?s)^(.*?){_NAME}\s*\{{(.*?)\}}\s*$"
MARKED_ARGUMENT = rf"(?s){_NAME}\s*:\s*{ARGUMENT_MARK}(.*?){ARGUMENT_MARK}"
QUOTED_CALL = rf"(?s)^(.*?){_NAME}\s*\(([^()]*)\)\s*\.?\s*$"
QUOTED_ARGUMENT = rf"(?s){_NAME}\s*=\s*[\"']([^\"']*)[\"']"


def tool_call(c: Column | str) -> Column:
    """``struct<name, arguments, prose>`` of a call that ends a message (F-S13); without a call that has arguments, name is null and prose the message."""
    text = F.coalesce(_col(c), F.lit(""))

    def arguments(call: str, argument: str) -> Column:
        body = F.regexp_extract(text, call, 3)
        pairs = F.arrays_zip(_all(body, argument, 1).alias("k"), F.transform(_all(body, argument, 2), F.trim).alias("v"))
        return _last_wins(pairs)

    marked = text.contains("<|") & text.rlike(MARKED_CALL)
    args = F.when(marked, arguments(MARKED_CALL, MARKED_ARGUMENT)).otherwise(arguments(QUOTED_CALL, QUOTED_ARGUMENT))
    part = lambda g: F.when(marked, F.regexp_extract(text, MARKED_CALL, g)).otherwise(F.regexp_extract(text, QUOTED_CALL, g))
    prose = F.trim(part(1))
    there = F.size(args) > 0
    return F.struct(F.when(there, part(2)).alias("name"), args.alias("arguments"), F.when(~there, text).when(prose != "", prose).otherwise(F.coalesce(F.try_element_at(args, F.lit("why")), F.lit(""))).alias("prose"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def split_jpegs(raw: pd.Series) -> pd.Series:
    """Images of a concatenated stream, cut where one starts (SC17)."""

    def cut(b: bytes | None) -> list[bytes]:
        mark = b"\xff\xd8\xff"
        return [mark + x for x in (b or b"").split(mark)[1:]]

    return raw.map(cut)


def item_verdict(watching: Column, describe: Column | str, least: float = 0.6) -> Column:
    """Verdict of the watch-list item that best covers a description: true, false or null.

    The first of equally good items wins; below ``least`` there is no answer.
    """
    want = term_set(describe, STOP_ITEMS)
    scored = F.transform(F.map_entries(watching), lambda e: F.struct(F.when(F.size(term_set(e["key"], STOP_ITEMS)) > 0, coverage(want, term_set(e["key"], STOP_ITEMS))).otherwise(F.lit(-1.0)).alias("s"), e["value"].alias("v")))
    best = F.aggregate(scored, F.struct(F.lit(-1.0).alias("s"), F.lit(None).cast("string").alias("v")), lambda a, e: F.when(e["s"] > a["s"], e).otherwise(a))
    return F.when((F.size(want) > 0) & (best["s"] >= least), best["v"] == "present")


