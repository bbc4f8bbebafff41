"""Sentence units of a text: the default sentence boundaries of Unicode (UAX #29), short ones joined, long ones cut at semicolons."""

from __future__ import annotations

import re

import regex

#: One letter for each Sentence_Break class.
CLASSES = {"CR": "P", "LF": "P", "Sep": "P", "Extend": "E", "Format": "E", "Sp": "S", "Lower": "l", "Upper": "u", "OLetter": "o", "Numeric": "n", "ATerm": "A", "STerm": "T", "SContinue": "K", "Close": "C"}
SHORT, LONG = 20, 300
_ORDER = [(regex.compile(rf"\p{{Sentence_Break={k}}}"), v) for k, v in CLASSES.items()]
END = re.compile("[AT]C*S*P?|P")
LOWER_AHEAD = re.compile("[^oulPAT]*l")


class _Classes(dict):
    """Code point -> class, worked out when it is first met; str.translate reads it."""

    def __missing__(self, point: int) -> str:
        self[point] = found = next((v for r, v in _ORDER if r.match(chr(point))), "x")
        return found


_classes = _Classes()


def boundaries(text: str) -> list[int]:
    """Places where a sentence ends, the text's end among them."""
    line = text.translate(_classes)
    place: range | list[int] = range(len(text))
    if "E" in line:
        kinds, place = line, [k for k, c in enumerate(line) if c != "E" or k == 0 or line[k - 1] == "P"]
        line = "".join(kinds[k] if kinds[k] != "E" else "x" for k in place)
    out, at = [], 0
    while m := END.search(line, at):
        s, e = m.span()
        at = e
        if line[e - 1] == "P":
            if text[place[e - 1]] == "\r" and e < len(line) and text[place[e]] == "\n":
                e = at = e + 1
        elif e < len(line):
            nxt = line[e]
            if nxt in "KAT":
                continue
            if line[s] == "A":
                if e == s + 1 and (nxt == "n" or (nxt == "u" and s and line[s - 1] in "ul")):
                    continue
                if LOWER_AHEAD.match(line, e):
                    continue
        out.append(place[e] if e < len(line) else len(text))
    if not out or out[-1] != len(text):
        out.append(len(text))
    return out


def sentences(text: str) -> list[str]:
    out, at = [], 0
    for b in boundaries(text):
        if part := text[at:b].strip():
            out.append(part)
        at = b
    return out


def units(text: str) -> list[str]:
    """Sentences of at least SHORT characters where possible; those over LONG are cut behind every semicolon."""
    joined: list[str] = []
    for s in sentences(text):
        if joined and len(joined[-1]) < SHORT:
            joined[-1] += " " + s
        else:
            joined.append(s)
    if len(joined) > 1 and len(joined[-1]) < SHORT:
        last = joined.pop()
        joined[-1] += " " + last
    out = []
    for u in joined:
        if len(u) <= LONG:
            out.append(u)
        else:
            parts = u.split(";")
            out += [p for p in (x.strip() + ";" * (k < len(parts) - 1) for k, x in enumerate(parts)) if p]
    return out
