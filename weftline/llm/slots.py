"""Unfilled template fields, and texts that say one thing over and over."""

from __future__ import annotations

import re

#: Template fields in the usual notations.
SLOT = re.compile(
    r"\{\{[^{}\n]*\}\}|[$#]\{+[^{}\n]*\}+|\{%[^%\n]*%\}|<%[^%\n]*%>|\{[A-Za-z_][\w.]*\}|\{\d+\}|%%[\w.]+%%|%[A-Z][A-Z_]+%|@@[\w.]+@@|(?<!\w)__[A-Za-z][\w.]*?__(?!\w)"
    r"|\[\[[\w. ]+\]\]|\[[A-Z][A-Z _]{2,}\]|\$[A-Za-z_][\w.]*\$|(?<![\w!])![A-Za-z][\w.]*!(?!\w)|&&[\w.]+&&|<<[\w.]+>>|<[A-Za-z_][\w.]*>|(?<!\[)\[[a-z_]+(?:\.[a-z_]+)?\d*\](?!\])"
)
#: Every notation has one of these.
_MARK = re.compile(r"[{%@_\[$<!&]")
_GAP = re.compile(r"[^\w]+")


def has_slot(text: str) -> bool:
    return bool(_MARK.search(text)) and bool(SLOT.search(text))


def repeats(text: str) -> bool:
    """One piece over and over, or no more than two distinct words.

    A piece must come three times, and a longer one as often as a third of its words: a sentence can be said thrice.
    A text of period d holds its own first two thirds at d; the search is linear, whatever the length of text and piece.
    """
    words = _GAP.sub(" ", text.lower()).split()
    if not any(map(str.isalpha, words)):
        return False
    if len(words) >= 3 and len(set(words)) <= (2 if len(words) > 3 else 1):
        return True
    line = " ".join(words)
    n = len(line)
    d = line.find(line[: max(1, 2 * n // 3)], 1)
    return 1 < d and 3 * d <= n + 1 and line[d:] == line[:-d] and 3 * len(words) >= (line.count(" ", 0, d) or 1) ** 2
