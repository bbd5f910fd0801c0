"""Labels for a sample of pages, from which the page model is fitted.

The tables hold no labels, and no list of phrases could cover all sites and
languages.  What the pages of a sample show by themselves is used instead:

* a line that recurs over pages (digits and the name of its site masked) is
  furniture unless it is a sentence within articles: one that also stands as
  a caption, or lies between the title and the last prose of its pages;
* an opening before a colon that recurs with changing ends is furniture
  ("...: other page"), unless it follows the title, as bylines do;
* list items that are no sentences, trails with ``>``, rows of links with bars,
  and titles followed by a dash and a sentence are links;
* a heading that recurs right above furniture belongs to it.

Lines that are mostly seen on pages without any prose (error pages) are never
taken for furniture by recurrence.  These labels are used for the sample only;
blocks of all pages are judged by the model.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: A line recurs if it is on so many pages of the sample.
RECURS = 4
#: A text of so many characters (or Chinese characters) that ends as a sentence is prose.
PROSE, PROSE_CJK = 120, 40
HEADING, PARAGRAPH, ITEM, TABLE, CAPTION = range(5)

_CJK = re.compile("[㐀-鿿]")
_END = re.compile(r"[.!?…。！？][\"”»)\]]*$")
_DRESS = re.compile(r"^[\s\[\]•»—!*–·-]+(?:\d{1,2}\.\s+)?|^\d{1,2}\.\s+|[\s\[\]•»—!*-]+$")
_OPENING = re.compile(r"^([^:：]{1,24})\s*[:：]\s*\S")
_BAR = re.compile(r"^[^|·]{1,30}(?:\s+[|·]\s+[^|·]{1,60}){2,}$")
_TEASER = re.compile(r"^.{4,90} — \S.{6,}[.。]$")
_DIGITS = re.compile(r"\d+")
_GAPS = re.compile(r"[^\w\x01]+")


def is_prose(text: str) -> bool:
    """Long enough for a paragraph of an article, and ends as a sentence."""
    n = len(text)
    return (n >= PROSE or n >= PROSE_CJK and bool(_CJK.search(text))) and bool(_END.search(text.rstrip()))


def site_name(source: str | None) -> str | None:
    """The word by which a site calls itself: the label before the last of its host."""
    host = (source or "").lower().split("://")[-1].split("/")[0].split(":")[0].strip(".")
    return (host.split(".")[-2] if "." in host else host) or None


def plain_lines(text: str) -> list[str]:
    """The lines without bullets, numbers and brackets around them; blank ones dropped."""
    return [x for line in text.split("\n") if (x := _DRESS.sub("", line.rstrip()))]


def masked(line: str, name: str | None) -> str:
    low = line.lower()
    return _GAPS.sub(" ", _DIGITS.sub("0", low.replace(name, "\x01") if name else low)).strip()


@dataclass
class _Seen:
    """Where a line (or opening) was met."""

    pages: set[int] = field(default_factory=set)
    n: int = 0
    with_prose: int = 0  #: on pages that have prose; the counts below are of these only
    after_title: int = 0
    outside: int = 0
    sentence: int = 0
    caption: int = 0


def sample_labels(page: list[int], kind: list[int], level: list[int], text: list[str], names: list[str | None], guarded) -> list[bool]:
    """Whether each block of the sample is furniture. ``guarded(text)`` tells blocks that are never labelled so (unfilled fields)."""
    n = len(text)
    lines = [plain_lines(t) for t in text]
    keys = [[masked(x, names[p]) for x in ls] for p, ls in zip(page, lines)]
    spread: dict[str, set[int]] = {}
    for p, ks in zip(page, keys):
        for k in ks:
            spread.setdefault(k, set()).add(p)
    own = [all(len(spread[k]) < RECURS for k in ks) for ks in keys]
    ends = [[bool(_END.search(x)) for x in ls] for ls in lines]
    openings = [[(m.group(1) if k != CAPTION and (m := _OPENING.match(x)) else None) for x in ls] for k, ls in zip(kind, lines)]
    seen: dict[str, _Seen] = {}
    title_of: list[int] = [-1] * n
    a = 0
    while a < n:
        b = a
        while b < n and page[b] == page[a]:
            b += 1
        heads = [i for i in range(a, b) if kind[i] == HEADING]
        title = next((i for i in heads if level[i] == 1), next((i for i in heads if own[i]), -1))
        prose = [i for i in range(a, b) if kind[i] == PARAGRAPH and own[i] and is_prose(text[i])]
        first = title if title >= 0 else prose[0] if prose else a
        last = max((i for i in range(a, b) if kind[i] == TABLE or kind[i] != HEADING and own[i] and ends[i] and ends[i][-1] and not _TEASER.match(lines[i][-1])), default=-1)
        for i in range(a, b):
            title_of[i] = title
            for x, k, e, o in zip(lines[i], keys[i], ends[i], openings[i]):
                for what in (k, f"{masked(o, names[page[i]])}:") if o else (k,):
                    s = seen.setdefault(what, _Seen())
                    s.pages.add(page[i])
                    s.n += 1
                    if prose:
                        s.with_prose += 1
                        s.after_title += 0 <= title < i <= title + 2
                        s.outside += i < first or i > last
                        s.sentence += e
                        s.caption += kind[i] == CAPTION
        a = b

    def recurs(key: str, opening: bool) -> bool:
        s = seen[key]
        if len(s.pages) < RECURS or 2 * s.with_prose < s.n or 2 * s.after_title > s.with_prose:
            return False
        return opening or 2 * s.sentence <= s.with_prose or (s.outside > 0.8 * s.with_prose and s.caption < 0.05 * s.with_prose)

    out = [False] * n
    for i in range(n - 1, -1, -1):  # from the end: a heading is judged by what follows it
        if not lines[i] or i == title_of[i] or kind[i] == TABLE:
            continue
        if kind[i] == HEADING:
            out[i] = all(len(seen[k].pages) >= RECURS for k in keys[i]) and not guarded(text[i]) and (i + 1 == n or page[i + 1] != page[i] or out[i + 1])
            continue
        free = not guarded(text[i])  # else only the form counts: a trail can end in an unfilled title
        found = []
        for x, k, e, o in zip(lines[i], keys[i], ends[i], openings[i]):
            again = free and (recurs(k, False) or bool(o) and recurs(f"{masked(o, names[page[i]])}:", True))
            form = kind[i] == PARAGRAPH and bool(x.count(" > ") > 1 or free and (_BAR.match(x) or _TEASER.match(x)))
            found.append(again or form or free and kind[i] == ITEM and not e)
        out[i] = all(found) if kind[i] == ITEM else 2 * sum(found) > len(found)
    return out


def bare_pages(page: list[int], kind: list[int], text: list[str], furniture: list[bool]) -> set[int]:
    """Pages without prose of their own and without a table: what they hold beside furniture stands in place of an article."""
    full = {p for p, k, t, f in zip(page, kind, text, furniture) if k == TABLE or k == PARAGRAPH and not f and is_prose(t)}
    return set(page) - full
