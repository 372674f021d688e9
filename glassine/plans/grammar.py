"""A deterministic grammar of queries and commands: words from tables, no model, nothing applied without a preview."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .people import LABELS

#: The words of the grammar.
VERBS = {
    "move": "move put send file".split(),
    "rate": "rate star".split(),
    "label": "label tag colour color mark".split(),
    "delete": "delete remove trash bin chuck erase".split(),
    "show": "show find search list".split(),
    "save": "save".split(),
}
FILLER = ("all of the", "all of my", "all of", "all the", "all my", "all", "the", "my", "of the", "of")
REFERENTS = "them these those it that".split()
MONTHS = (
    "january february march april may june july august september october november december"
).split()
TO = "to into in".split()


def verb_of(word: str) -> str | None:
    return next((v for v, words in VERBS.items() if word.lower() in words), None)


def edits(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours is one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def nearest_verb(word: str) -> str | None:
    """The verb that a mistyped word stands for: within two edits, fewer than half of its letters, same first letter."""
    word = word.lower()
    found = [(edits(word, s), v) for v, words in VERBS.items() for s in words if s[0] == word[:1]]
    found = [(d, v) for d, v in found if d <= (1 if len(word) < 4 else 2) and d * 2 < max(len(word), 3) and abs(len(word)) < 8]
    return min(found)[1] if found else None


def strip_filler(text: str) -> str:
    """text without leading words that select nothing."""
    text = text.strip()
    for words in FILLER:
        if text.lower().startswith(words + " "):
            return strip_filler(text[len(words) :])
    return text


@dataclass
class Clause:
    verb: str
    rest: str = ""
    target: str | None = None
    value: int | str | None = None
    referent: str | None = None
    empty: bool = False


def parse_clause(text: str) -> Clause | None:
    """A command's parts, or None if it doesn't begin with a verb: then it is a question."""
    first, _, rest = text.strip().partition(" ")
    verb = verb_of(first)
    if not verb:
        return None
    out = Clause(verb)
    rest = " " + rest.strip()
    if verb in ("move", "save"):
        cut = max(((rest.lower().rfind(f" {p} "), p) for p in TO), default=(-1, ""))
        if cut[0] >= 0:
            out.target = rest[cut[0] + len(cut[1]) + 2 :].strip()
            rest = rest[: cut[0]]
    rest = rest.strip()
    if verb == "rate" and (m := re.search(r"\b([0-5])\s*(?:stars?)?\s*$", rest, re.I)):
        out.value, rest = int(m[1]), rest[: m.start()]
    if verb == "label" and (m := re.search(rf"\b({'|'.join(LABELS)})\s*$", rest, re.I)):
        out.value, rest = m[1].lower(), rest[: m.start()]
    rest = strip_filler(rest.strip())
    if rest.lower() in REFERENTS:
        out.referent, rest = rest.lower(), ""
    out.rest = rest
    out.empty = not rest and not out.referent
    return out


def split_clauses(text: str) -> list[str]:
    """A sentence cut at 'and' or 'then' before a verb."""
    out, words = [[]], text.split()
    for i, w in enumerate(words):
        if w.lower() in ("and", "then") and i + 1 < len(words) and verb_of(words[i + 1]):
            out.append([])
        else:
            out[-1].append(w)
    return [" ".join(c) for c in out if c]


def is_command(text: str) -> bool:
    return parse_clause(text) is not None


class NeedsSlot(ValueError):
    """A command lacks something; its message is the question to ask."""


def check(clause: Clause) -> Clause:
    """clause, unless it selects nothing or lacks its destination or value."""
    if clause.empty:
        raise NeedsSlot(f"{clause.verb} which photos?")
    if clause.verb == "move" and not clause.target:
        raise NeedsSlot("move them where?")
    if clause.verb in ("rate", "label") and clause.value is None:
        raise NeedsSlot(f"{clause.verb} them how?")
    return clause


@dataclass
class Want:
    year: int | None = None
    month: int | None = None
    day: int | None = None
    people: list[str] = field(default_factory=list)
    min_rating: int | None = None
    label: str | None = None
    kind: str | None = None
    text: str = ""


def parse_query(text: str, people: list[str] = ()) -> Want:
    """What a query asks for; what isn't understood is left as text for names."""
    want, left = Want(), f" {text.strip()} "
    for name in sorted(people, key=len, reverse=True):
        m = re.search(rf"(?<!\w){re.escape(name)}(?!\w)", left, re.I)
        if m:
            want.people.append(name)
            left = left[: m.start()] + " " + left[m.end() :]
    words = left.split()
    only_colours = bool(words) and all(w.lower() in LABELS for w in words)
    rest = []
    for w in words:
        low = w.lower()
        name, colon, value = low.partition(":")
        if m := re.fullmatch(r"([1-5])stars?\+?", low):
            want.min_rating = int(m[1])
        elif colon and name in ("rating", "stars") and value.rstrip("+").isdigit():
            want.min_rating = int(value.rstrip("+"))
        elif colon and name == "label" and value in LABELS or only_colours:
            want.label = value or low
        elif colon and name == "type" and value in ("photo", "video"):
            want.kind = value
        elif colon and name in ("year", "month", "day") and value.isdigit():
            setattr(want, name, int(value))
        elif m := re.fullmatch(r"(\d{4})-(\d{2})(?:-(\d{2}))?", low):
            want.year, want.month = int(m[1]), int(m[2])
            want.day = int(m[3]) if m[3] else want.day
        elif re.fullmatch(r"(19|20)\d\d", low):
            want.year = int(low)
        elif len(low) >= 3 and any(month == low or month[:3] == low for month in MONTHS):
            want.month = next(i for i, month in enumerate(MONTHS, 1) if month == low or month[:3] == low)
        elif re.fullmatch(r"\d{1,2}(st|nd|rd|th)?", low) and 1 <= int(re.sub(r"\D", "", low)) <= 31:
            want.day = int(re.sub(r"\D", "", low))
        else:
            rest.append(w)
    want.text = strip_filler(" ".join(rest))
    return want


def predicate(want: Want) -> Column:
    """want as one condition over listings (path, kind, taken_at, rating, label, people)."""
    out = F.lit(True)
    for part, value in (("year", want.year), ("month", want.month), ("dayofmonth", want.day)):
        if value is not None:
            out &= getattr(F, part)("taken_at") == value
    for name in want.people:
        out &= F.array_contains("people", name)
    if want.min_rating is not None:
        out &= F.coalesce("rating", F.lit(0)) >= want.min_rating
    if want.label is not None:
        out &= F.coalesce(F.col("label") == want.label, F.lit(False))
    if want.kind is not None:
        out &= F.col("kind") == want.kind
    if want.text:
        out &= F.contains(F.lower("path"), F.lit(want.text.lower()))
    return out


def elsewhere(files, want: Want, scope: Column):
    """(here, elsewhere): matches within the scope and those it hides."""
    match = predicate(want)
    return files.agg(F.count_if(match & scope).alias("here"), F.count_if(match & ~scope).alias("elsewhere"))
