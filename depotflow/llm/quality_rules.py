"""Line-first cleaning of documents, and counts of words, symbols and repetition."""

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

from .common import text_of

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules, all inclusive on the failing side."""

    symbol_words: float = 0.5    # share of a line's words that hold a symbol or end in two marks
    nav_items: int = 4           # items between separators that make a navigation line
    nav_words: float = 3.0       # at most so many words an item on average
    max_lost: float = 0.5        # a document that loses more of its word characters is rejected
    boilerplate: tuple = ("all rights reserved", "licensed under", "released under the",
                          "privacy policy", "terms of use", "cookie policy",
                          "enable javascript", "subscribe to our newsletter")


MARKED = re.compile(rb"[#*$%&|<>]|[!?]{2}[.,;:]?$")
SUSPECT = re.compile(rb"[#*$%&|<>]|[!?]{2}")
SEPARATOR = re.compile(r"[|»›•·]|\s>\s")


def line_fault(line, rules):
    """Name of the first rule that a line with words breaks, or None."""
    raw = line.encode()
    words = raw.split()
    items = [x for x in SEPARATOR.split(line) if x.strip()] if SEPARATOR.search(line) else ()
    if len(items) >= rules.nav_items and len(words) <= rules.nav_words * len(items) + len(items):
        return "navigation"
    if SUSPECT.search(raw) and sum(bool(MARKED.search(w)) for w in words) >= rules.symbol_words * len(words):
        return "punctuation"
    low = line.lower()
    if any(phrase in low for phrase in rules.boilerplate):
        return "boilerplate"
    return None


def repeated_words(words, size=5):
    """Words inside windows of `size` words that occur twice or more, the first included."""
    windows = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    if len(set(windows)) == len(windows):
        return 0
    counts, total, covered = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + size - max(i, covered)
            covered = i + size
    return total


def judge_text(text, rules):
    """All figures of one text, in the order of `FIELDS`."""
    raw = text.encode()
    words = raw.split()
    seen, kept_lines, repeats, faults, lost = set(), [], 0, 0, 0
    for line in text.split("\n"):
        if not line.strip() and not line.encode().strip():
            kept_lines.append(line)
            continue
        repeats += line in seen
        seen.add(line)
        if line_fault(line, rules):
            faults += 1
            lost += len(line.encode().translate(None, WHITE).decode())
        else:
            kept_lines.append(line)
    chars = len(raw.translate(None, WHITE).decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeat_words = repeated_words(words)
    base = len(words) < 10 or 100 * repeat_words > 20 * len(words)
    share = lost / chars if chars else 0.0
    return (len(words), chars, symbols, repeats, repeat_words, base, faults, share,
            not base and share <= rules.max_lost, "\n".join(kept_lines))


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, n_lines_removed long, lost_share double, kept boolean, clean_text string")


def judge_documents(docs, text="text", rules=LineRules(), out="rules"):
    """Adds a struct `out` with the counts, the verdict and the cleaned text of every row.

    Each line with a word is held against the navigation, punctuation and
    boilerplate rules; failing lines are removed, blank lines stay. A document
    is kept if it passes the base counts and loses at most `max_lost` of its word
    characters. Null text counts as empty: no words, base failed. Rows are
    judged alone, so repeated rows, ties and other columns change nothing, and
    an empty table gives an empty table. One pass, no shuffle.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge_text(t, rules) for t in texts], columns=names)

    # as not deterministic it runs once, also where a filter on the verdict follows
    return docs.withColumn(out, judge.asNondeterministic()(text_of(text)))
