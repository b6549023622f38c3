"""Rules of single prompt and response pairs: empty, refusal, copy, language, ending."""

from __future__ import annotations

import re
import re._parser as _parser
import unicodedata
from collections import Counter
from collections.abc import Iterable, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

from scoreloom.llm.wordhash import hash_words

WORD = re.compile(r"[^\W_]+")

# Stand-ins for no output, as their words in lower case.
NO_OUTPUT = frozenset(
    """none|null|nil|nan|n a|na|empty|blank|void|undefined|missing|unavailable|not available|not applicable|no output|no response|no answer|
    no text|no content|no data|no result|no completion|no continuation|empty response|empty output|empty text|empty string|empty answer|
    null value|output|response|no output generated|no response generated|no text generated|placeholder|keine ausgabe|keine antwort|leer|
    aucune réponse|vide|sin respuesta|sin salida|vacío|нет ответа|пусто|нет вывода""".replace("\n", "").replace("    ", "").split("|")
)

# Function words by language: articles, pronouns, prepositions, conjunctions, auxiliaries and particles.
FUNCTION_WORDS = {
    "en": "the and of to in was were is are that which with for from by on at its their they he she his her this these those an has have had been be not but or as who it we you will would after before about into because when than there nobody another near under over behind between despite towards during",
    "de": "der die das und ist war waren von mit für auf im den dem des ein eine einen einer eines nicht auch sich wurde wurden werden wird sind hat haben hatte seit bei nach aus über unter vor neben zwischen durch noch wie dass diese dieser dieses jene jener unsere unser ihre danach zu an um als oder aber wenn weil niemand",
    "fr": "le la les des et est sont une un du de dans sur pour par avec qui que ne pas se ce cette ces leur leurs notre nos aux au elle il ils elles était étaient sera été depuis selon près sous derrière après avant mais ou où plus comme dont nous vous ont",
    "es": "el la los las de y en que un una del se es por con para su sus al lo como más pero fue fueron era está están ha han desde sobre entre hasta cuando muy sin también aquella aquel esta este esa ese nuestra nuestro según detrás cerca bajo los",
    "it": "il lo la gli le di che è un una del della dei delle nel nella con per non sono era erano come più anche ma questo questa dal dalla alla al si suo sua loro dopo prima sotto sopra tra ha hanno stato stata",
    "pt": "o a os as de e que em um uma do da dos das no na nos nas com para por não é são foi foram era mais como mas seu sua seus suas ao à também ele ela eles elas esta este está desde sobre entre até quando muito",
    "nl": "de het een en van in is was waren dat die met voor op aan bij naar uit over onder door niet ook zijn haar hun er maar als dan nog deze dit werd werden wordt heeft hebben had sinds tegen tussen achter voor na geen",
    "ru": "и в на с что не по как из за от до у о об для это был была были было его её их они она он который которая где при через после перед между под над возле около напротив каждый один этот эта тот свой наш весь мы потом",
}

# Words that grammar lets end no sentence: articles, possessives, conjunctions, and prepositions that can't stand without what follows.
ENDLESS = frozenset(
    """the a an and or nor of my your our their its every into onto upon than whose because although
    der die das dem den des ein eine einem einen einer und oder weil dass mein dein ihre unser für von vom zum zur im beim ins
    le la les un une des du et ou mes tes ses leurs nos vos de dans chez parce
    el los las una unos unas y o su sus de del al en con por para porque
    и или в на с к у о об от до из за для при без под над между через""".split()
)

# First letters of scripts other than Latin, as ranges of code points, and a language each stands for.
SCRIPTS = {"ru": (0x0400, 0x052F), "el": (0x0370, 0x03FF), "ar": (0x0600, 0x06FF), "he": (0x0590, 0x05FF), "hi": (0x0900, 0x097F), "ja": (0x3040, 0x30FF), "ko": (0xAC00, 0xD7AF), "zh": (0x4E00, 0x9FFF), "th": (0x0E00, 0x0E7F)}

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset(
    "mr mrs ms mx dr prof st no nos vs approx ca cf e.g i.e eg ie viz fig vol ch pp gen col lt sgt capt rev hon gov sen rep mt ft "
    "z.b d.h bzw nr hr fr u.a ggf evtl inkl vgl dipl str mme mlle p.ex env sr sra srta dra ej p.ej núm pág av т.е г ул им стр рис напр".split()
)

_QUOTES = str.maketrans({"’": "'", "‘": "'", "ʼ": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‟": '"', "〝": '"', "〞": '"', " ": " "})
_TERMINAL = ".!?…。！？‽"
_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: What may follow the end of a sentence.
_CLOSERS = _SPACE + "\"'»”’“)]}›*_`~\u200b\ufeff"

# Words of refusals.
_DEED = r"(?:help|assist|continue|carry on|go on|complet\w*|finish|writ\w+|answer\w*|respond\w*|repl\w+|provid\w+|produc\w+|generat\w+|creat\w+|compl[yi]\w*|fulfil\w*|discuss\w*|engage|proceed|do (?:that|this|so|it)|offer|draft|compose|extend)"
_THING = r"(?:texts?|passages?|stor(?:y|ies)|articles?|prompts?|requests?|topics?|subjects?|contents?|continuations?|completions?|responses?|answers?|questions?|pieces?|task|material|narratives?|that|this|it|here|with|about|you|more|so|instructions?)"
_UNABLE = (
    r"(?:can ?not|can't|cant|will not|won't|(?:am|are|is|be) (?:not able|unable|not allowed|not permitted|not willing|not going|unwilling|not in a position|not comfortable)|unable|'m not (?:able|allowed|permitted|willing|going)|"
    r"must (?:decline|refuse)|(?:have|need|has) to (?:decline|refuse|pass)|(?:decline|refuse)s?|(?:would|'d) (?:rather|prefer to|prefer) not|rather not|shall not|do not (?:wish|want|intend|feel comfortable))"
)
_SELF = r"(?:\b(?:i|we)\b|\bi'[md]\b|\bi'(?:ll|ve)\b|\bmy\b|\bme\b|\bthis (?:assistant|model|system|ai)\b|\bthe (?:assistant|model|ai)\b|\b(?:unable|sorry|apologies)\b)"
_REFUSALS = [
    rf"{_SELF}[^.!?]{{0,60}}?{_UNABLE}(?: (?:to|be|able|be able to|in good conscience|currently|simply|therefore|really))*(?:[^.!?]{{0,14}}?) ?\b{_DEED}\b(?=[^.!?]{{0,40}}\b{_THING}\b|[^\w]*$)",
    r"\bas an? (?:ai|assistant|(?:large )?language model|chat ?bot|artificial)\b[^.!?]{0,40}\b(?:i|we|my)\b",
    r"\bmy (?:\w+ )?(?:guidelines?|polic(?:y|ies)|instructions?|programming|rules|training|principles)\b[^.!?]{0,20}(?:do(?:es)? not|don't|doesn't|forbid|prohibit|prevent|bar|stop)",
    r"\bagainst (?:my|our) (?:\w+ ){0,2}(?:polic\w+|guidelines?|rules|principles|instructions)|\bagainst the (?:rules|guidelines|policies|instructions) (?:that )?(?:i|we)\b|\bviolat\w+ (?:my|our) ",
    r"\brequest (?:is |was |has been )?(?:declined|denied|refused|rejected|blocked)\b|\b(?:declined|blocked|refused)[:,] (?:content|safety|usage) ",
    r"\b(?:chosen|chooses?|decided|instructed|told|programmed|asked) not to (?:respond|answer|continue|discuss|reply|write|comment|generate|complete|help)\b[^.!?]{0,30}(?:prompt|request|safety|$)",
    r"\bthat is something i\b[^.!?]{0,40}\bnot\b|\bi have been (?:instructed|told|asked) not to\b",
    r"\bno (?:text|continuation|answer|response|output|completion|reply|content|further text)\b[^.!?]{0,20}\b(?:will|can|is|may|shall)\b[^.!?]{0,15}(?:generated|given|provided|produced|possible|written|offered|returned)\b",
    r"\bnothing (?:that )?i (?:am|'m|would be) (?:willing|able|allowed|permitted|prepared) to (?:add|say|write|offer|continue)",
    r"\boutside (?:of )?(?:what|the things|anything) i(?:'m| am|'ve| have| can| may)\b|\bbeyond what i(?:'m| am| can| may)\b",
    r"\bi (?:have|need|am required|am obliged|'ve) (?:got )?to (?:stay|keep|steer) (?:away|clear|out)\b|\bsubject i (?:have to|must|cannot|can't|won't|will not)\b",
    r"\b(?:it )?(?:would|is|will) (?:not be|be not|not|be in)\s?(?:appropriate|right|possible|inappropriate|proper|ethical) for me to\b|\b(?:would|will) be inappropriate for me to\b",
    r"\byou (?:ask|asked|want|wanted|told|tell|would like) me to\b[^\x00]{0,200}?\bi (?:will not|won't|cannot|can't|refuse|decline|must decline|shall not)\b(?=\W*$|[^.!?]{0,15}[.!?])",
    r"^\W*(?:no|sorry|apologies)[.,;!]\W*i (?:will not|won't|cannot|can't|shall not)(?: (?:do|write|continue|answer|help|complete|finish)\w*(?: (?:that|this|it|with that|with this|here))?)?\W*$",
    r"\b(?:i )?do(?:es)? not have (?:personal )?(?:opinions?|experiences?)\b[^.!?]{0,60}\bno answer\b|\bi do not have (?:personal )?opinions\b",
    # German
    r"\bals (?:sprachmodell|ki|assistent\w*|künstliche)\b|\banfrage\b[^.!?]{0,30}\b(?:nicht|ablehn\w*|leider)\b|\b(?:kann|darf|möchte|werde|will|könnte)\b[^.!?]{0,12}\bich\b[^.!?]{0,40}\bnicht\b[^.!?]{0,20}\b(?:helfen|fortsetzen|weiterschreiben|schreiben|beantworten|bearbeiten|fortfahren|erstellen|liefern)\b|"
    r"\bich (?:kann|darf|möchte|werde|will|muss)\b[^.!?]{0,50}\b(?:nicht|ablehnen|lieber nicht)\b[^.!?]{0,20}(?:helfen|fortsetzen|weiterschreiben|schreiben|beantworten|bearbeiten|fortfahren|erstellen|liefern|ablehnen|$)|\btut mir leid\b[^.!?]{0,50}\bnicht\b",
    # French
    r"\bmodèle de langue?a?g?e?\b|\bje (?:ne |n')(?:peux|puis|suis|souhaite|veux|vais|dois)\b[^.!?]{0,12}\bpas\b[^.!?]{0,40}\b(?:continuer|aider|répondre|écrire|poursuivre|compléter|terminer|produire|mesure|demande|texte|sujet)\b|\bje (?:dois|préfère|suis obligé\w* de)\b[^.!?]{0,20}\b(?:refuser|décliner|ne pas)\b",
    # Spanish
    r"\bmodelo de lenguaje\b|\bno (?:puedo|me es posible|debo|voy a|quiero|estoy autorizad\w+|se me permite)\b[^.!?]{0,20}\b(?:continuar|ayudar\w*|escribir|responder|completar|terminar|seguir|generar|producir)\b|\b(?:debo|tengo que|prefiero) (?:negarme|rechazar|declinar|no (?:continuar|escribir|responder))\b",
    # Russian
    r"\bязыков\w+ модел\w+\b|\b(?:я )?не (?:могу|буду|стану|имею права|в состоянии)\b[^.!?]{0,20}\b(?:продолж\w+|помо\w+|написать|писать|ответить|отвечать|закончить|завершить|создать)\b|\bмне не (?:разрешено|позволено|дозволено)\b|\bвынужден\w* отказ\w+",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in _REFUSALS), re.I)


def _strings(item: tuple) -> set[str] | None:
    """All strings that a part of a pattern stands for, nothing for what has no width; None if they are too many to list."""
    op, value = str(item[0]), item[1]
    if op == "LITERAL":
        return {chr(value)}
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}
    if op == "IN":
        return {chr(v) for _, v in value} if all(str(k) == "LITERAL" for k, v in value) else None
    if op == "SUBPATTERN":
        return _product(value[3])
    if op == "BRANCH":
        parts = [_product(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and value[:2] == (0, 1):
        one = _product(value[2])
        return None if one is None else one | {""}
    return None


def _product(items: Iterable[tuple]) -> set[str] | None:
    out = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(out) * len(more) > 400:
            return None
        out = {x + y for x in out for y in more}
    return out


def _needed(items: Sequence[tuple]) -> set[str] | None:
    """Strings of which every match has at least one: of the choices in a row of parts the one that should be rarest."""
    choices, run = [], {""}
    for item in items:
        more = _strings(item)
        if more is not None and len(run) * len(more) <= 400:
            run = {x + y for x in run for y in more}
            continue
        choices.append(run)
        run = more or {""}
        op, value = str(item[0]), item[1]
        if more is None and op == "BRANCH":
            parts = [_needed(list(x)) for x in value[1]]
            if None not in parts:
                choices.append(set().union(*parts))
        elif more is None and (op == "SUBPATTERN" or (op in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0)):
            choices.append(_needed(list(value[-1])) or {""})
    choices = [c for c in (*choices, run) if "" not in c]
    return min(choices, key=lambda c: sum(20.0 ** -len(x) for x in c), default=None)


def _hints(patterns: Iterable[str]) -> tuple[str, ...]:
    """Strings of which every text that a pattern matches has at least one, without those that hold another."""
    each = set()
    for p in patterns:
        own = _needed(list(_parser.parse(p)))
        if own is None:
            raise ValueError(f"no string is in all matches of {p}")
        each |= {_plain(x) for x in own}
    return tuple(sorted(x for x in each if not any(y in x for y in each if y != x)))


def _plain(text: str) -> str:
    """Letters that match each other without regard to case made the same."""
    low = text.casefold()
    return low if low.isascii() else low.replace("i\u0307", "i").replace("ı", "i")


def _tree(strings: Sequence[str]) -> str:
    """A pattern of sorted strings, none of them the beginning of another, that reads common beginnings once."""
    if len(strings) == 1:
        return re.escape(strings[0])
    heads: dict[str, list[str]] = {}
    for x in strings:
        heads.setdefault(x[0], []).append(x[1:])
    parts = [re.escape(c) + _tree(rest) for c, rest in heads.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


#: Taken from the patterns: a sentence without any of these strings can't match; a cheap first look.
_HINTS = _hints(_REFUSALS)
_HINT = re.compile(_tree(_HINTS))


def is_empty(text: str | None) -> bool:
    """Null, nothing visible, only punctuation, or a stand-in for no output."""
    if not text:
        return True
    if len(text) > 200:
        return not any(c.isalnum() for c in text)
    words = WORD.findall(text.lower())
    return not words or (len(words) <= 4 and " ".join(words) in NO_OUTPUT)


_STOP = re.compile(r"[.!?…]\s+")
_MARK = re.compile(r"[\"“”„‟«»]")


def own_voice(text: str, prompt: str | None) -> str:
    """The text without what stands in quotation marks.

    A straight mark opens behind white space before a letter or another mark,
    and closes elsewhere; a closing mark ends all quotations.  One without an
    opening mark ends a quotation that the prompt began if it is the text's
    first mark, else one that began with its sentence; an opening mark that
    nothing closes quotes its sentence.
    """
    spans, begin, seen = [], None, False
    for m in _MARK.finditer(text):
        i, c = m.start(), m.group()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        opens = c in "„«“‟" or (c == '"' and (not before or before.isspace() or before in "([\"—–-") and (after.isalnum() or after in "\"¿¡'…"))
        if c == "“" and begin is not None and text[begin] == "„":
            opens = False
        if opens:
            begin = i if begin is None else begin
        elif begin is not None:
            spans.append((begin, i + 1))
            begin = None
        else:
            last = spans[-1][1] if spans else 0
            starts = [m.end() for m in _STOP.finditer(text, last, i)] if seen else []
            spans.append((starts[-1] if starts else last, i + 1))
        seen = True
    if begin is not None:
        stop = _STOP.search(text, begin)
        spans.append((begin, stop.start() + 1 if stop else len(text)))
    if not spans:
        return text.translate(_QUOTES)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return " ".join([*out, text[at:]]).translate(_QUOTES)


def is_refusal(text: str, prompt: str | None) -> bool:
    """The writer declines to go on; people in the text who decline do not count."""
    said = " ".join(own_voice(text, prompt).split())
    if not _hinted(said):
        return False
    pieces = _SENTENCE.split(said)
    for i, piece in enumerate(pieces):
        if _hinted(piece):
            # With the sentence before it; a letter stands for what is left out, so that only the text's own ends are ends.
            whole = " ".join(pieces[max(0, i - 1) : i + 1])
            if _REFUSAL.search(("x\x00 " if i > 1 else "") + whole + (" \x00x" if i + 1 < len(pieces) else "")):
                return True
    return False


_SENTENCE = re.compile(r"(?<=[.!?]) ")


def _hinted(text: str) -> bool:
    return _HINT.search(_plain(text)) is not None


def is_copy(text: str, prompt: str | None) -> bool:
    """Nothing but the prompt, or most of it, again, with small changes.

    At least three quarters of the text's words and half of the prompt's are
    common to both in the same order.
    """
    if not prompt:
        return False
    t, p = WORD.findall(text.lower()), WORD.findall(prompt.lower())
    if not p or len(t) < 0.5 * len(p) or 3 * len(t) > 4 * len(p) + 6:
        return False
    if sum((Counter(t) & Counter(p)).values()) < 0.75 * (len(t) - 2):
        return False
    same = sum(m.size for m in SequenceMatcher(None, t, p, autojunk=False).get_matching_blocks())
    return same >= 0.75 * (len(t) - 2) and same >= 0.75 * min(len(t), len(p)) and same >= 0.5 * len(p)


def stops_openly(text: str) -> bool:
    """Ends without a mark that ends a sentence, or after an abbreviation."""
    bare = text.rstrip(_CLOSERS)
    while bare and unicodedata.category(bare[-1]) in ("So", "Sk", "Cf", "Cc", "Mn"):
        bare = bare[:-1].rstrip(_CLOSERS)
    if not bare or bare[-1] not in _TERMINAL:
        return True
    words = bare.rsplit(None, 2)[-2:]
    last = words[-1].lower()
    if not last.endswith(".") or last.endswith("..") or last.lstrip("([\"'«“„").rstrip(".") not in ABBREVIATIONS:
        return False
    # "No." is an answer where a sentence begins.
    return not (last.lstrip("([\"'«“„") == "no." and len(words) == 2 and words[0].rstrip(_CLOSERS)[-1:] in _TERMINAL and words[0].rstrip(_CLOSERS))


def without_end(text: str) -> str:
    """The text without its last marks: what a shortened version has in common with the whole one."""
    return text.rstrip(_CLOSERS + _TERMINAL)


def goes_on(after: str) -> bool:
    """Whether a longer text, after the shorter one's last word, is still inside the sentence."""
    return not (after.lstrip("\"'»”’)]")[:1] in _TERMINAL and after)


@lru_cache(maxsize=1)
def language_table() -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, sorted hashes of function words, bit set of the languages each belongs to)."""
    names = list(FUNCTION_WORDS)
    bits: dict[int, int] = {}
    for i, name in enumerate(names):
        for h in hash_words([FUNCTION_WORDS[name]])[0].tolist():
            bits[h] = bits.get(h, 0) | 1 << i
    keys = np.array(sorted(bits), dtype=np.uint64)
    return names, keys, np.array([bits[int(k)] for k in keys], dtype=np.int64)


def language_votes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Function words of each language in each text; a word that several languages have counts for each of them."""
    names, keys, bits = language_table()
    slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = np.flatnonzero(keys[slot] == h)
    row = np.searchsorted(offsets, hit, side="right") - 1
    mask = bits[slot[hit]]
    out = np.zeros((len(offsets) - 1, len(names)), dtype=np.int64)
    for i in range(len(names)):
        own = row[(mask >> i) & 1 > 0]
        out[:, i] = np.bincount(own, minlength=len(out))
    return out


def script_of(text: str) -> str | None:
    """The language a text's script stands for, if more than half of its letters are not Latin."""
    if text.isascii():
        return None
    letters, seen = 0, Counter()
    for c in text:
        if c.isalpha():
            letters += 1
            if ord(c) >= 0x370:
                for name, (a, b) in SCRIPTS.items():
                    if a <= ord(c) <= b:
                        seen[name] += 1
                        break
    if not seen:
        return None
    name, n = seen.most_common(1)[0]
    return name if 2 * n > letters else None


def language(votes: np.ndarray, script: str | None) -> tuple[str | None, int]:
    """(language, its votes); none below two votes or on a tie."""
    names = language_table()[0]
    if script and script not in names:
        return script, 1 << 20
    order = np.argsort(-votes, kind="stable")
    best, second = int(votes[order[0]]), int(votes[order[1]])
    if script:
        return script, max(2, int(votes[names.index(script)]))
    return (names[int(order[0])], best) if best >= 2 and best > second else (None, best)
