"""Sentence units of every document, across languages and scripts (problem 10).

The rules are compiled into finite machines (``machine``), which read the texts of a batch, one
behind the other, in chunks: a chunk is a state-transition function, and the functions are
composed by a parallel prefix scan, so a document of many megabytes is so many chunks.

1. ``before`` reads from the left and knows, at the end of a run of sentence marks and of what
   closes behind it, what stood before: an abbreviation (a trie of them is part of its states),
   an initial, a number, a word.
2. ``ahead`` reads from the right and knows what follows: letter case, digits, marks, a month, the
   end of the paragraph.  Both states together decide, by a table made from the rules beforehand,
   whether the run can end a sentence.
3. ``quoted`` picks the speech and brackets that close; marks inside them count for nothing if the
   sentence began before them or goes on behind them.
4. ``cutter`` takes what they found, one symbol a character, and writes where sentences begin.

Lines that begin with a list marker or a time stamp, links and signs that trail at a line's end are
regular expressions that give their characters symbols of their own before the machines run.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, tasks
from .machine import CHUNK, Machine

#: characters of documents handled at once
RUN_CHARS = 300_000
#: characters from which on a document is cut at blank lines and dealt out
PIECE = 1_000_000

# ---- where sentences begin, from one symbol a character ----

TEXT, SPACE, LINE, STOP, LEAD, TAIL, GAP, START = range(8)
# states: before a sentence; in one; it ended; ended, then space; in one after a line break; ended, then a line break
BETWEEN, INSIDE, ENDED, AFTER, WRAPPED, TURNED = range(6)
_NEXT = {
    TEXT: [INSIDE] * 6, LEAD: [INSIDE] * 6, STOP: [ENDED] * 6, START: [BETWEEN] * 6,
    SPACE: [BETWEEN, INSIDE, AFTER, AFTER, WRAPPED, TURNED],
    LINE: [BETWEEN, WRAPPED, TURNED, TURNED, BETWEEN, BETWEEN],
    TAIL: [INSIDE, INSIDE, AFTER, AFTER, INSIDE, INSIDE],
    GAP: [BETWEEN, AFTER, AFTER, AFTER, AFTER, TURNED],
}
#: states in which a symbol begins a sentence
_BEGINS = {TEXT: (BETWEEN, ENDED, AFTER, TURNED), LEAD: (BETWEEN, ENDED, AFTER, WRAPPED, TURNED), STOP: (BETWEEN, AFTER, TURNED), TAIL: (BETWEEN, TURNED)}


@functools.cache
def cutter() -> tuple[Machine, np.ndarray]:
    """The machine, and by symbol and state before it whether a sentence begins."""
    machine = Machine(BETWEEN, 8, lambda state, symbol: _NEXT[symbol][state])
    return machine, np.array([[state in _BEGINS.get(symbol, ()) for state in machine.states] for symbol in range(8)])


def transduce(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """1 at each symbol that begins a sentence."""
    machine, begins = cutter()
    after = machine.run(symbols, chunk=chunk)
    return begins[symbols, np.concatenate(([0], after[:-1]))[: len(symbols)]].astype(np.uint8)


# ---- the rules' words ----

# Abbreviations whose full stop never ends a sentence, in lower case (here and below after Unicode's CLDR sentence-break suppressions and dictionaries' lists).
JOINING = frozenset(
    "dr prof mr mrs ms sra dra srta ts ths vs cf approx aprox ca yakl ок см e.g i.e z.b d.h u.a p.ej p.ex ex bkz örn bzw vgl т.е т.к т.н г-н डॉ पृ श्री "
    "messrs mme mlle mgr inż dott avv dipl ing lic arq sig sigg exmo exma ilmo evtl ggf inkl exkl zzgl sog bspw tzn tzw np m.in wg viz напр".split()
)
# Those that are titles only with a capital, and those that need a number behind them.
TITLES = frozenset("sr jr hr fr gs gen gov sen rep lt col sgt rev hon др проф st capt cpt cmdr adm maj brig pres supt insp atty cpl pvt geom rag on ks płk kol акад доц".split())
NUMBERED = frozenset(
    "no nr nº núm fig figs рис стр табл p pp pág págs pag tr vol art sec secs ch chap eq eqs para abs bd kap abb abschn anm art cap sez rys tab ust poz num n гл разд п пп ver vers fasc bl hal".split()
)
# Abbreviations that may stand at a sentence's end.
ENDING = frozenset(
    "u.s u.k u.n e.u a.m p.m etc inc ltd co corp llc jr al st ave rd jan feb mar apr jun jul aug sep sept oct nov dec usw v.b v.v vb тыс млн млрд т.д т.п г гг руб д п ecc".split()
)
# German month names after an ordinal number.
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())

_COMMA = frozenset(",;:，、；：،؛")
_DASH = frozenset("-–—―")
_STOPS = frozenset(".!?。！？…．।॥؟｡")
#: what closes behind a sentence's end; “ does so too where no letter or digit follows
_CLOSE = frozenset(")]}）】］」”’»›\"'*_")
#: pairs: what opens, what closes, and what must not stand between
_PAIRS = (("“", "”", "“"), ("„", "“”", "„"), ("«", "»", "«"), ("「", "」", "「"), ("『", "』", "『"), ('"', '"', ""), ("'", "'", ""), ("‘", "’", "‘"), ("(", ")", "("), ("（", "）", "（"), ("【", "】", "【"), ("[", "]", "["))

_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"“”«»「」()（），。！？、]*[^\s<>\"“”«»「」()（），。！？、.,;:!?…']")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LEAD = re.compile(r"(?m)^[^\S\n]*(?:(?P<stamp>\[\d{1,2}:\d{2}(?::\d{2})?\](?:[^\S\n]*@?[^\s:：]+[:：])?)|(?P<item>\d+[.)](?=\s)|[-–•‣◦·*](?=[^\S\n]))|(?P<sign>[#>]+(?=[^\S\n])|(?:Q|A|问|答|質|問)[:：]))")
_TAIL = regex.compile(r"(?:[^\S\n]*(?:<\|\w+\|>|[\p{So}\p{Sk}\p{Cs}\u200d\ufe0f\U0001f3fb-\U0001f3ff]+))+(?=[^\S\n]*(?:\n|\Z))")


# ---- characters as symbols ----

_KINDS = (
    "start line space wide_space dot full_dot ellipsis other_dot stop wide_stop hidden_dot hidden_stop comma ascii_comma wide_comma dash wide_dash digit wide_digit taint link "
    "other wide_other number close underscore wide_close open wide_open mark lower upper letter"
).split()
_K = {k: i for i, k in enumerate(_KINDS)}
#: letters that abbreviations and months are written in; each has a symbol of its own, and one as a capital
_LETTERS = "".join(sorted({c for w in JOINING | TITLES | NUMBERED | ENDING | {m.lower() for m in MONTHS} for c in w if c.isalpha() or unicodedata.category(c)[0] == "M"} | set("abcdefghijklmnopqrstuvwxyz")))
_LOWER = {c: len(_KINDS) + i for i, c in enumerate(_LETTERS)}
_UPPER = {c.upper(): len(_KINDS) + len(_LETTERS) + i for i, c in enumerate(_LETTERS) if len(c.upper()) == 1 and c.upper() != c}
SYMBOLS = len(_KINDS) + 2 * len(_LETTERS)


def _kind(c: str) -> str:
    """What a character is to the rules, but for letters of abbreviations."""
    ascii_ = c.isascii()
    if c == "\x00":
        return "start"
    if c == "\n":
        return "line"
    if c.isspace():
        return "space" if ascii_ else "wide_space"
    for chars, kind in ((".", "dot"), ("．", "full_dot"), ("…", "ellipsis"), ("。｡", "other_dot"), ("!?", "stop"), ("！？।॥؟", "wide_stop"), (",", "comma"), ("$%", "taint"), ("/\\@=&", "link"), ("_", "underscore")):
        if c in chars:
            return kind
    if c in _COMMA:
        return "ascii_comma" if ascii_ else "wide_comma"
    if c in _DASH:
        return "dash" if ascii_ else "wide_dash"
    if c in _CLOSE:
        return "close" if ascii_ else "wide_close"
    if any(c == p[0] or c in p[1] for p in _PAIRS):
        return "open" if ascii_ else "wide_open"
    if c.isdigit():
        return "digit" if ascii_ else "wide_digit"
    if c.isalpha():
        return "lower" if c.islower() else "upper" if c.isupper() else "letter"
    if unicodedata.category(c)[0] == "M":
        return "mark"
    if c.isalnum():
        return "number"
    return "other" if ascii_ else "wide_other"


class _Traits:
    """What the symbols are, as arrays of booleans, and the letter that a symbol stands for."""

    def __init__(self) -> None:
        kind = [*_KINDS, *["lower"] * (2 * len(_LETTERS))]
        for s in _UPPER.values():
            kind[s] = "upper"
        for c, s in _LOWER.items():
            kind[s] = "mark" if unicodedata.category(c)[0] == "M" else "lower" if c.islower() else "letter"
        self.kind = kind
        self.letter = [""] * SYMBOLS
        for c, s in _LOWER.items():
            self.letter[s] = c
        for c, s in _UPPER.items():
            self.letter[s] = c.lower()
        wide = {"wide_space", "full_dot", "ellipsis", "other_dot", "wide_stop", "wide_comma", "wide_dash", "wide_digit", "wide_other", "number", "wide_close", "wide_open", "mark", "lower", "upper", "letter"}
        self.ascii = np.array([c.isascii() if (c := self.letter[s]) else k not in wide for s, k in enumerate(kind)])
        is_ = lambda *kinds: np.array([k in kinds for k in kind])
        self.space = is_("line", "space", "wide_space")
        self.stop = is_("dot", "full_dot", "ellipsis", "other_dot", "stop", "wide_stop")
        self.comma, self.dash, self.digit = is_("comma", "ascii_comma", "wide_comma"), is_("dash", "wide_dash"), is_("digit", "wide_digit")
        self.lower, self.upper = is_("lower"), is_("upper")
        self.alpha = is_("lower", "upper", "letter")
        self.alnum = self.alpha | self.digit | is_("number")
        self.word = self.alnum | is_("underscore")
        self.close = is_("close", "wide_close", "underscore")
        self.link = is_("link", "underscore")
        self.token = self.alpha | is_("mark")


TRAITS = _Traits()
_symbol_of = np.full(0x110000, -1, np.int16)
_unseen_of, _sign_of = np.zeros(0x110000, bool), np.zeros(0x110000, bool)


def _symbols_of(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; what a code point is is found out once."""
    out = _symbol_of[points]
    if (out < 0).any():
        for p in np.unique(points[out < 0]).tolist():
            c = chr(p)
            low = _LOWER.get(c, _UPPER.get(c))
            _symbol_of[p] = low if low is not None else _K[_kind(c)]
            category = unicodedata.category(c)
            _unseen_of[p] = c.isspace() or category[0] == "C"
            _sign_of[p] = category in ("So", "Sk", "Cs") or c in "\u200d\ufe0f"  # what _TAIL looks for
        out = _symbol_of[points]
    return out


# ---- what stood before a run of marks ----


def _prefixes(words: frozenset[str]) -> set[str]:
    return {w[:i] for w in words for i in range(1, len(w) + 1)}


_WHOLE, _TITLE = _prefixes(JOINING | TITLES | NUMBERED | ENDING), _prefixes(TITLES)
_LAST = _prefixes(frozenset(w for w in ENDING if "." not in w))
#: how far back a token is looked at
_FAR = 14

# States of ``before``, as tuples by their first field:
#   ("base", ASCII, taken, point)        no token and no number; taken: a digit or currency sign stands there, point: a full stop or comma
#   ("digits", how many up to 3, point before them, ASCII)
#   ("token", whole, last, letters, dotted, capital, case, ASCII, taken)   letters, marks and full stops: the whole of it and what follows its last full stop, None where no word of the tries begins so
#   ("run", kind, left, live, closing)   in a run of marks or what closes behind it; left: what stood before it, live: the state without the run


def _token(live: tuple, s: int) -> tuple:
    """After a letter or a mark."""
    c, capital, cased = TRAITS.letter[s], bool(TRAITS.upper[s]), bool(TRAITS.upper[s] or TRAITS.lower[s])
    if live[0] == "token":
        _, whole, last, n, dotted, capital, _, _, taken = live
    else:
        whole, last, n, dotted, taken = "", "", 0, False, live[0] == "digits" or live[2]
    n += 1
    taken = taken and n < _FAR
    whole = whole + c if whole is not None and c and not taken and whole + c in _WHOLE else None
    if last == "" and not taken:
        last = c if c in _LAST else "?" if cased else None  # a single letter is one whatever it is
    else:
        last = last + c if last and c and not taken and last + c in _LAST else None
    return ("token", whole, last, min(n, _FAR if taken else 5), dotted, capital and whole in _TITLE, "upper" if TRAITS.upper[s] else "lower" if TRAITS.lower[s] else "", bool(TRAITS.ascii[s]), taken)


def _full_stop(live: tuple) -> tuple:
    """After a full stop, as far as a token is concerned."""
    if live[0] != "token":
        return ("base", True, live[0] == "digits" or live[2], True)
    _, whole, _, n, _, capital, _, _, taken = live
    whole = whole + "." if whole is not None and whole + "." in _WHOLE else None
    return ("token", whole, "", min(n + 1, _FAR if taken else 5), True, capital and whole in _TITLE, "", True, taken)


_LEFT = "digit ascii lower upper some joining numbered title capital ending last_ending single single_ending one long many monthly".split()


def _left(live: tuple) -> tuple:
    """What the rules ask of what stands before a run: a boolean for each of _LEFT."""
    at = dict.fromkeys(_LEFT, False)
    if live[0] == "token":
        _, whole, last, n, dotted, capital, case, at["ascii"], taken = live
        at["lower"], at["upper"] = case == "lower", case == "upper"
        if not taken:
            ending = lambda w: w is not None and w in ENDING
            single = last is not None and len(last) == 1 and (last == "?" or last.upper() != last)
            at |= {"some": True, "joining": whole in JOINING, "numbered": whole in NUMBERED, "title": whole in TITLES, "capital": capital and whole in TITLES, "ending": ending(whole)}
            at |= {"last_ending": dotted and ending(last), "single": single, "single_ending": single and ending(last), "one": n == 1, "long": n >= 4 and not dotted}
    elif live[0] == "digits":
        at |= {"digit": True, "ascii": live[3], "many": live[1] == 3, "monthly": live[1] < 3 and not live[2]}
    else:
        at["ascii"] = live[1]
    return tuple(at.values())


_FIRST = {"dot": "one", "full_dot": "one", "ellipsis": "dots", "other_dot": "mark", "stop": "mark", "wide_stop": "mark"}


def _before(state: tuple, s: int) -> tuple:
    kind, run = TRAITS.kind[s], state[0] == "run"
    live = state[3] if run else state
    if TRAITS.stop[s]:
        behind = _full_stop(live) if kind == "dot" else ("base", bool(TRAITS.ascii[s]), False, False)
        if not run or state[4]:
            # a single ideographic stop is told apart from those of a row of dots
            return ("run", "single" if kind == "other_dot" else _FIRST[kind], _left(live), behind, False)
        dots = kind not in ("stop", "wide_stop") and state[1] != "mark"
        return ("run", "dots" if dots else "mark", state[2], behind, False)
    if run and TRAITS.close[s]:
        return ("run", state[1], state[2], ("base", bool(TRAITS.ascii[s]), False, False), True)
    if TRAITS.token[s]:
        return _token(live, s)
    if kind == "hidden_dot":
        return _full_stop(live)
    if TRAITS.digit[s]:
        ascii_ = bool(TRAITS.ascii[s])
        if live[0] == "digits":
            return ("digits", min(live[1] + 1, 3), False, ascii_)
        return ("digits", 1, live[0] == "base" and live[3] or live[0] == "token" and live[2] == "", ascii_)
    return ("base", bool(TRAITS.ascii[s]), kind == "taint", kind == "comma")


# ---- what follows ----

_RIGHT = "comma dash free digit upper lower alpha link ascii month".split()
_MONTH_ENDS = {m[i:] for m in MONTHS for i in range(len(m))}
_END = ("end",)

# States of ``ahead``: ("end",) of a paragraph; ("at", traits of the character, the word from it on as far as a month may end so);
# ("gap", with a line break, what follows it: traits, or None at a paragraph's end)


def _ahead(state: tuple, s: int) -> tuple:
    kind, t = TRAITS.kind[s], TRAITS
    if kind == "start":
        return _END
    if t.space[s]:
        if state[0] == "gap":
            line = kind == "line"
            return ("gap", state[1] or line, None if line and state[1] else state[2])
        return ("gap", kind == "line", state[1] if state[0] == "at" else None)
    word = ""
    if t.word[s]:
        rest = state[2] if state[0] == "at" else ""
        c = t.letter[s].upper() if t.upper[s] else t.letter[s]
        word = c + rest if c and rest is not None and c + rest in _MONTH_ENDS else None
    at = (bool(t.comma[s]), bool(t.dash[s]), bool(t.dash[s]) and state[0] != "at", bool(t.digit[s]), bool(t.upper[s]), bool(t.lower[s]), bool(t.alpha[s]), bool(t.link[s]), bool(t.ascii[s]), word in MONTHS)
    return ("at", at, word)


def _may_end(kind: str, left: tuple, closing: bool, right: tuple) -> bool:
    """Whether a run of marks with what stood before it, what closes behind it and what follows can end a sentence."""
    was = dict(zip(_LEFT, left))
    if right[0] == "end" or right[0] == "gap" and right[2] is None:
        return True
    tight = right[0] == "at"
    c = dict(zip(_RIGHT, right[1] if tight else right[2]))
    if tight and c["comma"] or not tight and not right[1] and c["dash"] and c["free"]:
        return False
    if kind == "dots":
        return not (c["lower"] or c["comma"])
    if kind != "one":
        return not (tight and c["ascii"] and (c["lower"] or c["digit"]))  # such as ?a=1 of an address without its scheme
    if tight and not closing:  # something stands right behind it
        if c["digit"]:
            return not (was["digit"] or was["ascii"])
        if c["upper"]:
            return (was["lower"] or was["digit"] or not was["ascii"]) and not (was["one"] or was["joining"] or was["title"])
        if c["alpha"]:
            return not c["lower"] and not (was["ascii"] and was["upper"] and was["one"])
        return not c["link"]
    weak = c["lower"] or c["digit"]
    if was["joining"] or was["numbered"] and c["digit"] or was["capital"] and c["upper"] and not was["ending"]:
        return False
    if was["ending"] or was["last_ending"]:
        return not weak
    if was["single"]:  # an initial
        return was["single_ending"] and was["lower"] and not weak
    if c["comma"]:
        return False
    if c["lower"]:  # text without capitals, unless what stands before may be an abbreviation or an ordinal
        return was["long"] or not was["some"] and was["many"]
    return not (was["monthly"] and c["upper"] and c["month"])


# ---- speech and brackets ----

_CLOSES = {c: i for i, c in enumerate(dict.fromkeys("".join(p[1] for p in _PAIRS)), 1)}
_OPENERS = len(_PAIRS) + 1


def _quoted(state: int, s: int) -> int:
    """0 outside, else the number of the pair that is open; a symbol is what a character opens, if that closes, and what it closes."""
    closes, opens = divmod(s, _OPENERS)
    if state:
        return 0 if closes and list(_CLOSES)[closes - 1] in _PAIRS[state - 1][1] else state
    return opens


class Rules:
    """The machines, and the table that says by their states whether a sentence can end."""

    def __init__(self) -> None:
        self.before, self.ahead = Machine(("base", True, False, False), SYMBOLS, _before), Machine(_END, SYMBOLS, _ahead)
        self.quoted = Machine(0, _OPENERS * (len(_CLOSES) + 1), _quoted)
        runs = [s if s[0] == "run" else None for s in self.before.states]
        self.in_run = np.array([r is not None for r in runs])
        self.closing = np.array([r is not None and r[4] for r in runs])
        lefts = list(dict.fromkeys((r[1], r[2], r[4]) for r in runs if r))
        number = {x: i for i, x in enumerate(lefts)}
        self.left = np.array([number[r[1], r[2], r[4]] if r else 0 for r in runs])
        rights = list(dict.fromkeys(s[:2] if s[0] == "at" else s for s in self.ahead.states))
        number = {x: i for i, x in enumerate(rights)}
        self.right = np.array([number[s[:2] if s[0] == "at" else s] for s in self.ahead.states])
        self.table = np.array([[_may_end(kind, left, closing, r) for r in rights] for kind, left, closing in lefts])
        for m in (self.before, self.ahead):
            m.states = []  # the tasks need the numbers only


@functools.cache
def rules() -> Rules:
    return Rules()


# ---- a batch of texts ----


def _previous(hit: np.ndarray) -> np.ndarray:
    """At each place the last one up to it that is a hit; -1 where there is none."""
    return np.maximum.accumulate(np.where(hit, np.arange(len(hit)), -1))


def _following(hit: np.ndarray) -> np.ndarray:
    """At each place, and behind the last, the first one from it on that is a hit; the length where there is none."""
    n = len(hit)
    return np.append(np.minimum.accumulate(np.where(hit, np.arange(n), n)[::-1])[::-1], n)


def _cover(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether a place lies in one of the stretches [lo, hi)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def _hidden(r: Rules, points: np.ndarray, raw: np.ndarray, region: np.ndarray, starters: np.ndarray) -> np.ndarray:
    """Marks there end nothing: speech and brackets that began in a sentence or that it goes on after.

    ``region`` numbers the paragraphs, -1 between them; ``starters`` are the last characters of list
    markers and the like.  What neither began in a sentence nor goes on is a region of its own next.
    """
    t, n = TRAITS, len(points)
    hidden = np.zeros(n, bool)
    curly = points == ord("“")
    space, close, stop, word = t.space[raw], t.close[raw], t.stop[raw], t.word[raw]
    seen, solid = _following(~space), _previous(~space)
    unclosed, untailed, unstopped = _previous(~close), _previous(~(close | curly)), _previous(~stop)
    lines = np.concatenate(([0], np.cumsum(raw == _K["line"])))
    goes_on = t.alnum[raw] | t.comma[raw] | t.dash[raw] | stop | close
    marks = np.isin(points, np.array(sorted({ord(c) for p in _PAIRS for c in "".join(p)}), np.uint32))
    while True:
        at = np.flatnonzero(marks & (region >= 0))
        if not len(at):
            return hidden
        change = np.flatnonzero(np.diff(region)) + 1
        bounds = np.concatenate((change, [n]))
        end = bounds[np.searchsorted(change, at, "right")]  # of the region each mark is in
        begin = np.concatenate(([0], change))[np.searchsorted(change, at, "right")]
        p = points[at]
        opens, closes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for c, k in _CLOSES.items():
            closes[p == ord(c)] = k
        for k, (o, ends, bad) in enumerate(_PAIRS, 1):
            mine = np.flatnonzero(p == ord(o))
            if not len(mine):
                continue
            related = np.flatnonzero(np.isin(p, [ord(c) for c in ends + bad]))
            nth = np.searchsorted(related, mine, "right")
            mine, nth = mine[nth < len(related)], nth[nth < len(related)]
            to = related[nth]
            ok = np.isin(p[to], [ord(c) for c in ends]) & (region[at[to]] == region[at[mine]])
            if o in "'[":
                ok &= (at[mine] == 0) | ~word[at[mine] - 1]
            if o == "'":
                after = at[to] + 1
                ok &= ~space[np.minimum(at[mine] + 1, n - 1)] & ((after >= end[to]) | ~word[np.minimum(after, n - 1)])
            opens[mine[ok]] = k
        state = r.quoted.run(closes * _OPENERS + opens)
        was = np.concatenate(([0], state[:-1]))
        first, last = np.flatnonzero((was == 0) & (state > 0)), np.flatnonzero((was > 0) & (state == 0))
        o, c, lo, hi = at[first], at[last], begin[first], end[first]
        j = np.where(o > 0, solid[o - 1], -1)
        j2 = np.where(j >= 0, unclosed[j], -1)
        began = (j >= lo) & ~starters[j] & ((j2 < lo) | ~stop[j2])
        k = np.minimum(seen[c + 1], n - 1)
        near = k == c + 1
        spaced = t.lower[raw[k]] | t.comma[raw[k]] | t.dash[raw[k]] & ((k + 1 >= hi) | (points[np.minimum(k + 1, n - 1)] == 32)) & (lines[k] == lines[c + 1])
        on = (seen[c + 1] < hi) & np.where(near, goes_on[k], spaced)
        e = np.maximum(unstopped[np.maximum(untailed[c], 0)] + 1, o)
        whole, part = on, ~on & began
        hidden |= _cover(n, np.concatenate((o[whole], o[part])), np.concatenate((c[whole] + 1, np.maximum(e, o)[part])))
        inner = ~on & ~began & (c > o + 1)
        if not inner.any():
            return hidden
        region = np.full(n, -1, np.int64)
        within = _cover(n, o[inner] + 1, c[inner])
        region[within] = np.searchsorted(o[inner], np.flatnonzero(within), "left")


def spans(texts: list[str], r: Rules | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every sentence of all texts; positions count the text's code points."""
    r = r or rules()
    texts = [x or "" for x in texts]
    joined = "".join("\x00" + x.replace("\x00", "\x01") for x in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    begin = np.cumsum([0, *(len(x) + 1 for x in texts)])
    none = np.empty(0, np.int64)
    if not n:
        return none, none, none
    raw, t = _symbols_of(points), TRAITS
    first = points == 0
    space, line = t.space[raw], raw == _K["line"]
    out = np.where(first, START, np.where(line, LINE, np.where(space, SPACE, TEXT)))

    # lines that begin with a marker, signs at a line's end, links
    starters, hidden, items = np.zeros(n, bool), np.zeros(n, bool), []
    signed = np.add.reduceat(_sign_of[points], begin[:-1], dtype=np.int64) > 0
    for x, a, sign in zip(texts, begin.tolist(), signed.tolist()):
        for m in _LEAD.finditer(x):
            starters[a + m.end()] = True
            if m.lastgroup != "sign":
                out[a + 1 + m.start(m.lastgroup)] = LEAD
                if m.lastgroup == "item":
                    items.append(a + m.end())
        if sign or "<|" in x:
            for m in _TAIL.finditer(x):
                part = out[a + 1 + m.start() : a + 1 + m.end()]
                part[part == TEXT] = TAIL
        if "://" in x or "www." in x:
            for m in _LINK.finditer(x):
                hidden[a + 1 + m.start() : a + 1 + m.end()] = True

    # white space: paragraphs end where it holds two line breaks, in Thai a sentence where it holds none
    edge = np.flatnonzero(np.diff(np.concatenate(([0], space.astype(np.int8), [0]))))
    lo, hi = edge[::2], edge[1::2]
    lines = np.concatenate(([0], np.cumsum(line)))
    count = lines[hi] - lines[lo]
    breaks = _cover(n, np.flatnonzero(line)[lines[lo[count >= 2]]], hi[count >= 2]) | first
    region = np.where(breaks, -1, np.cumsum(breaks))
    shown = np.bincount(np.cumsum(breaks), ~_unseen_of[points] & ~first) > 0
    out[~shown[np.cumsum(breaks)] & ((out == TEXT) | (out == TAIL))] = SPACE
    thai = (points >= 0x0E01) & (points <= 0x0E3A) | (points >= 0x0E40) & (points <= 0x0E4E)
    gaps = (count == 0) & (lo > 0) & (hi < n)
    gaps[gaps] = thai[lo[gaps] - 1] & thai[hi[gaps]]
    out[lo[gaps]] = GAP

    # runs of marks that can end a sentence, with what closes behind them
    hidden |= _hidden(r, points, raw, region, starters)
    sym = raw.astype(np.int64)
    following = np.append(raw[1:], _K["start"])
    sym[(points == ord("“")) & ~t.alnum[following]] = _K["wide_close"]
    sym[hidden & t.stop[raw]] = np.where(points == 46, _K["hidden_dot"], _K["hidden_stop"])[hidden & t.stop[raw]]
    sym[[i for i in items if t.stop[raw[i]]]] = _K["hidden_dot"]
    before, ahead = r.before.run(sym), np.append(r.ahead.run(raw, backward=True), 0)
    run, closing = r.in_run[before], r.closing[before]
    following = np.append(sym[1:], _K["start"])
    last = np.flatnonzero(run & ~t.close[following] & ~(t.stop[following] & ~closing))
    earlier = np.concatenate(([False], run[:-1] & ~closing[:-1]))
    begins = np.flatnonzero(run & ~closing & ~(earlier & run))
    ends = r.table[r.left[before[last]], r.right[ahead[last + 1]]]
    out[_cover(n, begins[ends], last[ends] + 1)] = STOP

    starts = np.flatnonzero(transduce(out))
    if not len(starts):
        return none, none, none
    seen = np.flatnonzero((out != SPACE) & (out != LINE) & (out != GAP) & (out != START))
    # a sentence ends after the last visible character before the next one begins, or before the next text
    stops = seen[np.searchsorted(seen, np.append(starts[1:], n), "left") - 1] + 1
    text = np.searchsorted(begin, starts, "right") - 1
    return text, starts - begin[text] - 1, stops - begin[text] - 1


def pieces(text: str, least: int) -> list[tuple[int, str]]:
    """(offset, part) of a text, cut at blank lines, where every sentence ends, into parts of ``least`` characters or more."""
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        if m.end() - at >= least:
            out.append((at, text[at : m.end()]))
            at = m.end()
    return [*out, (at, text[at:])] if at < len(text) or not out else out


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(id_col, start_pos, end_pos): one row for each sentence; start_pos is its first character that is not white space, end_pos one past its last.

    Null, empty and blank texts, and paragraphs of nothing visible, give no rows; a repeated row
    gives its sentences again; a null id stays null; other columns are not read.  A text of more
    than ``piece`` characters is cut at blank lines into pieces that are dealt out to the tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(rules())  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts, offsets = b["id"].to_numpy(), b["text"].tolist(), b["off"].to_numpy()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size < RUN_CHARS or to == at):
                    size += len(texts[to] or "")
                    to += 1
                k, start, end = spans(texts[at:to], held.value)
                yield pd.DataFrame({id_col: ids[at:to][k], "start_pos": (start + offsets[at:to][k]).astype(np.int32), "end_pos": (end + offsets[at:to][k]).astype(np.int32)})
                at = to

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t in zip(b["id"], b["text"]):
                for off, part in pieces(t, piece):
                    yield pd.DataFrame({"id": pd.Series([i], dtype=b["id"].dtype), "text": [part], "off": [off]})

    out = f"`{id_col}` {kind}, start_pos int, end_pos int"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    usual = spread(rows.where(F.length("text") <= piece).withColumn("off", F.lit(0))).mapInPandas(run, out)
    long = rows.where(F.length("text") > piece).mapInPandas(cut_up, f"id {kind}, text string, off int")
    return usual.unionByName(long.repartition(tasks(docs.sparkSession), "id", "off").mapInPandas(run, out))
