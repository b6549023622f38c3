"""Texts folded to a small alphabet in which disguised spellings look like the plain ones."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from scoreloom.llm.wordhash import code_points

# Symbols: 0 blank, 1-26 letters, 27 number, 28 end of sentence, 29 other mark; DROP vanishes.
BLANK, NUMBER, END, MARK, DROP = 0, 27, 28, 29, 255
SYMBOLS = 32

# Letters of other scripts by the Latin letters they look like, or else sound like.
LOOK_ALIKES = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "j", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "p", "с": "c", "т": "t", "у": "y", "ф": "f", "х": "x", "ц": "c", "ч": "q", "ш": "w", "щ": "w", "ы": "y", "э": "e",
    "ю": "u", "я": "r", "ё": "e", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ӏ": "l", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "y",
    "α": "a", "β": "b", "γ": "y", "δ": "d", "ε": "e", "ζ": "z", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "π": "n", "ρ": "p",
    "σ": "o", "ς": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ß": "s", "æ": "a", "ø": "o", "œ": "o", "đ": "d", "ł": "l", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
#: Digits and marks that stand for letters inside words.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l", "|": "l"}
#: Marks that are put between the letters of a word or in place of one.
INSERTED = "*.-_'’·•~^+=#"
#: Marks that may stand between the end of a sentence and the next.
CLOSING = "\"'”’»)]"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol of each code point, letter that a stand-in stands for or 0, whether a mark may be inserted in words, whether it closes a quotation)."""
    n = sys.maxunicode + 1
    symbol = np.full(n, MARK, dtype=np.uint8)
    for c in range(n):
        x = chr(c)
        kind = unicodedata.category(x)
        if kind[0] in "LNM" or kind in ("Cf", "Cc", "Zs", "Zl", "Zp"):
            if x in "\n\r  ":
                symbol[c] = END
            elif kind[0] == "Z" or x in "\t\v\f":
                symbol[c] = BLANK
            elif kind in ("Mn", "Me", "Cf", "Cc"):
                symbol[c] = DROP
            elif kind[0] == "N":
                symbol[c] = NUMBER
            else:
                low = LOOK_ALIKES.get(x.lower(), x.lower())
                base = unicodedata.normalize("NFKD", low)[:1].lower()
                base = LOOK_ALIKES.get(base, base)
                if "a" <= base <= "z":
                    symbol[c] = ord(base) - 96
                else:
                    symbol[c] = 1 + c % 26
        elif x in ".!?…。！？":
            symbol[c] = END
    stand = np.zeros(n, dtype=np.uint8)
    for k, v in STAND_INS.items():
        stand[ord(k)] = ord(v) - 96
    inserted = np.zeros(n, dtype=bool)
    inserted[[ord(c) for c in INSERTED]] = True
    closing = np.zeros(n, dtype=bool)
    closing[[ord(c) for c in CLOSING]] = True
    return symbol, stand, inserted, closing


def fold(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all sentences, offsets of the sentences, text of each sentence).

    Case, accents, look-alike letters, invisible characters, stand-ins inside
    words, marks between the letters of a word, letters spaced out and letters
    drawn out are folded away; a sentence ends at an end mark before white
    space, or at a line end.  Sentences without letters are left out.
    """
    joined = "\n".join(t or "" for t in texts) + "\n"
    cp = code_points(joined)
    symbol, stand, inserted, closing = _tables()
    s = symbol[cp]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t or "") + 1 for t in texts])
    keep = s != DROP
    cp, s, row = cp[keep], s[keep], row[keep]
    n = len(s)
    letter = (s >= 1) & (s <= 26)
    prev_letter, next_letter = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    prev_letter[1:] = letter[:-1]
    next_letter[:-1] = letter[1:]
    # Stand-ins between letters, or next to one inside a word; a number of its own stays one.
    swap = (stand[cp] > 0) & (prev_letter | next_letter)
    s = np.where(swap, stand[cp], s)
    letter |= swap
    prev_letter[1:] = letter[:-1]
    next_letter[:-1] = letter[1:]
    # Marks inside a word vanish; all other ends of sentences need white space behind them.
    gone = inserted[cp] & prev_letter & next_letter & ~swap
    after_blank = np.ones(n, dtype=bool)
    after_blank[:-1] = (s[1:] == BLANK) | (s[1:] == END) | (cp[1:] == 10)
    after_blank[:-2] |= closing[cp[1:-1]] & ((s[2:] == BLANK) | (s[2:] == END))
    line = (cp == 10) | (cp == 13)
    s = np.where((s == END) & ~line & ~after_blank & ~gone, MARK, s)
    keep = ~gone
    s, row, line = s[keep], row[keep], line[keep]
    # Runs of one symbol: letters at most twice in a row and, if drawn out, once; blanks and marks once.
    edge = np.ones(len(s), dtype=bool)
    edge[1:] = s[1:] != s[:-1]
    start = np.flatnonzero(edge)
    run = np.repeat(np.diff(np.append(start, len(s))), np.diff(np.append(start, len(s))))
    place = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    is_letter = (s >= 1) & (s <= 26)
    keep = (place == 0) | (is_letter & (run == 2))
    s, row = s[keep], row[keep]
    # Letters spaced out: at least three words of one letter in a row lose the blanks between them.
    is_letter = (s >= 1) & (s <= 26)
    n = len(s)
    around = np.ones(n + 2, dtype=bool)
    around[1:-1] = ~(is_letter | (s == NUMBER))
    alone = is_letter & around[:-2] & around[2:]
    spot = np.flatnonzero(alone)
    if len(spot) > 2:
        chain = np.diff(spot) == 2
        chain &= (s[spot[:-1] + 1] == BLANK) | (s[spot[:-1] + 1] == MARK)
        long = chain.copy()
        long[1:] &= chain[:-1]
        both = np.zeros(len(chain), dtype=bool)
        both |= long
        both[:-1] |= long[1:]
        both &= chain
        drop = np.zeros(n, dtype=bool)
        drop[spot[:-1][both] + 1] = True
        s, row = s[~drop], row[~drop]
    # Sentences.
    n = len(s)
    cut = np.flatnonzero((s == END) | (np.diff(row, append=-1) != 0)) + 1
    begin = np.concatenate([[0], cut[:-1]])
    has = np.add.reduceat(((s >= 1) & (s <= 26)).astype(np.int64), begin) if n else np.zeros(0, dtype=np.int64)
    good = has > 1
    size = (cut - begin)[good]
    take = np.repeat(begin[good] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return s[take], np.concatenate([[0], np.cumsum(size)]), row[begin[good]]


def show(s: np.ndarray) -> str:
    """Folded symbols in readable form."""
    return "".join(" " if x == BLANK else chr(96 + x) if x <= 26 else {NUMBER: "#", END: ".", MARK: ","}[int(x)] for x in s)
