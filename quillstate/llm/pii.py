"""Personal information in free text: a semi-Markov conditional random field over spans.

Candidate spans of a line are proposed by shape alone (mail-like, digit runs, a house number
beside words, runs of name-like words with all their sub-runs). A log-linear model scores
every (span, kind) by features of the whole span: its shape, its words' classes, its
neighbours, the head of its line. Spans are bounded in length; a dynamic program over
(position, kind of the last span) picks the best set of non-overlapping spans, boundaries
and kinds together. Text outside spans scores 0. The same lattice with sums in place of
maxima gives the likelihood by which the weights are trained (``pii_train``); they are
shipped in ``pii_weights.json``.

Every line is decoded, whatever it looks like: no pattern stands before the model. What
candidates share (the inside of a span by its shape, the words before a start, the words after
an end) is scored once and kept; a candidate is left out only where the weights prove that no
best segmentation holds it (``Model``).

Defined results: a NULL or an empty text holds nothing; every distinct (kind, text) of a
document is one row, exactly as written; spans never cross a line end; the redacted text
replaces each span by its placeholder and leaves every other character as it is; repeated
documents are repeated rows of ``redact``; an empty table gives no rows. Only ``doc_id`` and
``text`` are used, so other columns cannot clash.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate
from math import inf
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "phone", "identity", "address", "name"]
PLACEHOLDER = {"email": "<EMAIL>", "phone": "<PHONE>", "identity": "<ID>", "address": "<ADDRESS>", "name": "<NAME>"}
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.json")
#: Characters before and after a span that its features see.
NEAR = 24

#: Words, and lines, whose result a task keeps at most; those of LONG characters are not kept.
CACHED, LONG = 1 << 16, 400

# ---- fixed word lists -----------------------------------------------------------------
PARTICLES = {"von", "van", "der", "den", "de", "la", "del", "dos", "da", "di", "du", "bin", "al", "ter", "af", "zu"}
TITLES = {"dr", "mr", "mrs", "ms", "prof", "herr", "frau", "sr", "sra", "mme", "m", "mlle", "sir", "dr.", "mr.", "mrs.", "ms.", "prof.", "sr.", "sra.", "mme.", "m."}
STREET_END = {"street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "close", "court", "ct", "drive", "dr", "terrace", "quay", "way", "place", "square", "row", "crescent", "walk", "hill", "boulevard", "blvd", "gardens", "grove", "mews", "parade"}
STREET_START = {"rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée", "quai", "calle", "c/", "avenida", "plaza", "paseo", "camino", "rua", "travessa", "praça", "largo", "via", "viale", "piazza", "am", "an", "im", "auf", "ulica", "ул.", "улица", "проспект"}
STREET_SUFFIX = ("straße", "strasse", "str.", "gasse", "weg", "platz", "ring", "allee", "damm", "ufer", "gata", "gatan", "vägen", "straat", "laan", "gade", "vej")
CALENDAR = {"mon", "tue", "wed", "thu", "fri", "sat", "sun", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"}

#: Words, in several languages, that announce a kind.
_CUE_WORDS = {
    "phone": "tel phone telephone telefon telefono teléfono téléphone telefone mobile mobil handy cell call dial ring fax sms whatsapp hotline pager appeler appelez llamar llame ligar ligue anrufen rufnummer durchwahl звонить позвонить телефон тел 電話 電話番号",
    "identity": "ssn social security passport pasaporte passeport passaporte reisepass pass ausweis personalausweis nino ni national identity identification tax steuer taxid tin nif nie dni cpf insee nir sécurité sociale documento identidad identidade id ids паспорт паспорта снилс инн 旅券 旅券番号 番号 マイナンバー personnummer insurance licence license",
    "address": "street address addresses adresse anschrift dirección morada endereço адрес адресу 住所 ship shipping deliver delivered delivery parcel courier lives resident billing lieferung livraison",
    "person": "name names author authors owner owned contact maintainer customer client user person reviewer reporter patient employee colleague manager sir madam thanks thank merci danke gracias obrigado спасибо",
}
CUES = {w: kind for kind, words in _CUE_WORDS.items() for w in words.split()}
_CUES = frozenset(CUES)

# ---- candidates -------------------------------------------------------------------------
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]|_")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MAILS = [
    re.compile(r"(?<![\w.+%-])[\w.+%-]++(?:[@＠]|[ ]?[(\[{<][ ]?(?:at|AT|@)[ ]?[)\]}>][ ]?)[\w-]+(?:(?:\.|[ ]?[(\[{][ ]?(?:dot|DOT)[ ]?[)\]}][ ]?|[ ](?:dot|DOT)[ ])[\w-]+)+"),
    re.compile(r"(?<![\w.+%-])(?=([\w.+%-]++[ ](?:at|AT)[ ][\w-]+(?:(?:\.|[ ]?[(\[{][ ]?(?:dot|DOT)[ ]?[)\]}][ ]?|[ ](?:dot|DOT)[ ])[\w-]+)+))"),
]
# every repetition below has one way to match, so that no text makes a pattern try twice
_DIGITS = re.compile(r"(?<![\w.])(?:[+＋]|\(\+?)?(?:[A-Z]{1,2}[ -]?)?\d(?:(?:[ \t]|[ \t]?[-./()][ \t]?)?\d){5,24}(?:-?[A-Z]\b|[ ][A-Z]\b)?(?!\w)")
_HOUSE = r"\d{1,5}(?:[ ]?[a-zA-Z]\b)?(?:[ ](?:bis|ter))?"
_AW = r"(?:[^\W\d_]+\.?(?:['’-][^\W\d_]+)*|C/)"
_FRONT = re.compile(rf"(?<![\w./:+-])({_HOUSE})(,)?[ ]({_AW}(?:[ ]{_AW}){{0,4}})")
_BACK = re.compile(rf"(?<![\w./:+@-])({_AW}(?:[ ]{_AW}){{0,4}})(,)?[ ]({_HOUSE})(?![\w:/]|[.,-]\d)")
_LETTERS = re.compile(r"[^\W\d_]+")
_NAME = r"[^\W\d_]++(?:['’][^\W\d_]++)*+\.?"
_NAME_WORD = re.compile(_NAME)
_NEXT = rf"(?:(?:[ \u00a0\u3000]|-|,[ ]|[ ]-[ ]){_NAME})"
_RUN, _LONG_RUN = re.compile(rf"(?<![^\W\d_]){_NAME}{_NEXT}*+"), re.compile(rf"(?<![^\W\d_]){_NAME}{_NEXT}++")
#: ``_LONG_RUN`` as plain ASCII needs it.
_ASCII_RUN = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:'[A-Za-z]++)*+\.?(?:(?: |-|, | - )[A-Za-z]++(?:'[A-Za-z]++)*+\.?)++")
_CJK_NAME = re.compile(r"[\u4e00-\u9fff々]{1,4}[ \u3000]?[\u4e00-\u9fff\u3040-\u309f々]{1,5}")
# what every form of a kind must hold; only lines without it are spared the forms
_CJK = re.compile(r"[\u4e00-\u9fff]")
_HOUSE_BESIDE = re.compile(r"\d(?: ?[a-zA-Z])?(?: (?:bis|ter))?,? [^\W\d_]|[^\W\d_][./]?,? \d")
#: The letters of street words: a line in plain ASCII without any of them holds no address.
_STREETS = {x for w in STREET_END | STREET_START for x in re.findall(r"[^\W\d_]+", w)}
_TAILS = {w.rstrip(".")[-3:] for w in STREET_SUFFIX}
_WIDE = str.maketrans("０１２３４５６７８９－＋＠", "0123456789-+@")
_FOLDED = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalpha() else 32 for i in range(256))
_SHAPE = str.maketrans("0123456789０１２３４５６７８９－＋＠" + ascii_lowercase + ascii_uppercase, "d" * 20 + "-+@" + "a" * 26 + "A" * 26)


class _Kept(dict):
    """Values of a function of one word, the latest of them kept."""

    def __init__(self, f: Callable):
        self.f = f

    def __missing__(self, w: str):
        if len(self) >= CACHED:
            self.clear()
        v = self[w] = self.f(w)
        return v


class Gazetteer:
    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        # a single word can be a name only if one of its parts is listed
        self.parts = frozenset(w for x in given | family for w in _LETTERS.findall(x))
        self.classes = _Kept(self._word_class)

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Gazetteer:
        given, family = set(), set()
        for part, role in rows:
            if part:
                (given if role == "given" else family).add(part.casefold())
        return cls(given, family)

    def _word_class(self, w: str) -> str:
        """G/F/B known given, family, both; U capital; A capitals; i initial; p particle; t title; c calendar; l other."""
        bare = w.rstrip(".")
        low = bare.casefold()
        if low in PARTICLES and not bare.isupper():
            return "p"
        if low in TITLES and len(bare) > 1 and bare[0].isupper():
            return "t"
        tail = low.split("'")[-1].split("’")[-1]
        g, f = low in self.given, low in self.family or tail in self.family
        if g or f:
            k = "B" if g and f else "G" if g else "F"
            return k.lower() if bare.islower() else k
        if len(bare) == 1 and bare.isupper():
            return "i"
        if low in CALENDAR:
            return "c"
        if bare.isupper() and len(bare) > 1:
            return "A"
        if bare[:1].isupper():
            return "U"
        return "l"


def shape(s: str) -> str:
    return s.translate(_SHAPE)


def _edge(c: str) -> str:
    """The class of the character beside a span."""
    return "^" if not c else "s" if c in " \t\u3000" else "0" if c.isdigit() else "w" if c.isalpha() else "q" if c in "\"'`<>()[]{}|（）「」" else c if c in ",;:/.=-@" else "x"


def _left(left: str) -> tuple[str, list[str]]:
    """The token at the end of the ``NEAR`` characters before a span, and the features that only a start decides."""
    lt = _TOKEN.findall(left.casefold())
    cues = () if _CUES.isdisjoint(lt) else sorted({CUES[t] for t in lt if t in CUES})
    lt = ["0" if t.isdigit() else t for t in lt[-3:]]
    l3, l2, l1 = (["^"] * 3 + lt)[-3:]
    words = [t for t in lt if t[0].isalpha()]
    out = [f"l1={l1}", f"l2={l2} {l1}", f"l3={l3} {l2} {l1}", "lw=" + (words[-1] if words else "^"), "le=" + _edge(left[-1:])]
    out += [f"lb={w}" for w in sorted({*words[:-1]})] + [f"lcue={c}" for c in cues]
    if left[-1:].isspace():
        out.append("lspace")
    return l1, out


def _right(right: str) -> tuple[str, list[str]]:
    """The token at the start of the ``NEAR`` characters after a span, and the features that only an end decides."""
    rt = _TOKEN.findall(right.casefold())
    cues = () if _CUES.isdisjoint(rt) else sorted({CUES[t] for t in rt if t in CUES})
    rt = ["0" if t.isdigit() else t for t in rt[:3]]
    r1, r2 = (rt + ["$"] * 2)[:2]
    words = [t for t in rt if t[0].isalpha()]
    return r1, [f"r1={r1}", f"r2={r1} {r2}", "rw=" + (words[0] if words else "$"), "re=" + _edge(right[:1]), *[f"rcue={c}" for c in cues]]


def _words(line: str) -> list[str]:
    """The runs of letters of a line, case folded."""
    return line.encode().translate(_FOLDED).decode().split() if line.isascii() else _LETTERS.findall(line.casefold())


def _line(words: list[str]) -> tuple[str, ...]:
    """The features that all spans of a line share: its first word, and whether a cue word stands anywhere in it."""
    head = "head=" + (words[0] if words else "")
    if _CUES.isdisjoint(words):
        return "bias", head
    return "bias", head, *[f"cue={c}" for c in sorted({CUES[w] for w in words if w in CUES})]


def _email_feats(s: str, trimmed: bool) -> list[str]:
    out = ["at=" + ("@" if "@" in s or "＠" in s else "word")]
    local, _, host = s.replace("＠", "@").partition("@")
    if trimmed:
        out.append("trimmed")
    if host:
        out.append("tld=" + ("num" if host.rsplit(".", 1)[-1].isdigit() else "alpha"))
        out.append("media" if re.search(r"\.(?:png|jpe?g|gif|svg|css)$", host, re.I) or re.match(r"\d+x\.", host) else "host")
        out.append("semver" if re.match(r"\d+\.\d+\.\d+", host) else "nover")
        out.append("local=" + ("git" if local == "git" else "x"))
        if not re.search(r"[A-Za-z]", local):
            out.append("nolocal")
    else:
        out.append("dots=" + str(min(2, len(re.findall(r"\b(?:dot|DOT)\b", s)))))
        out.append("form=" + re.sub(r"[\w.+-]+", "", re.sub(r"\b(?:at|AT|dot|DOT)\b", "W", s))[:6])
    return out


def _digit_feats(sh: str, first: str, cut: bool) -> list[str]:
    """Features of a run of digits by its shape and its first two characters (``00``, or a leading 0 or 1)."""
    groups = re.findall("d+", sh)
    n, seps = sh.count("d"), "".join(sorted(set(re.sub(r"[dAa]", "", sh))))
    out = ["cut"] if cut else []
    out += ["shape=" + sh, f"n={n}", "seps=" + seps, "start=" + sh[:2], "end=" + sh[-2:], f"groups={len(groups)}", "lens=" + "-".join(str(len(x)) for x in groups)]
    lead = "+" if sh[0] == "+" else "(" if sh[0] == "(" else "A" if sh[0].isalpha() else first
    out += ["lead=" + lead, f"lead+n=lead={lead}{n}"]
    if re.fullmatch(r"d{1,3}(?:\.d{1,3}){3}", sh):
        out.append("ipv4")
    if sh == "dddd-dd-dd":
        out.append("isodate")
    if re.fullmatch(r"d+(?:\.d+)+", sh) and not re.fullmatch(r"dd(?:\.dd){4}|ddd\.ddd\.dddd", sh):
        out.append("dotted")
    return out


def _digit_key(s: str, cut: bool) -> tuple[str, str, bool]:
    return shape(s), "00" if s[:2] == "00" else s[0] if s[0] in "01" else "d", cut


def _address_feats(words: tuple[str, ...], front: bool, comma: bool, number: str, longer_left: str, longer_right: str) -> list[str]:
    low = [w.casefold() for w in words]
    end, start = low[-1] in STREET_END, low[0] in STREET_START
    suffix = any(w.endswith(STREET_SUFFIX) and len(w) > 5 for w in low[-1:])
    caps = sum(w[0].isupper() for w in words)
    kind = "end" if end else "start" if start else "suffix" if suffix else ""
    if not kind:  # no word of the span names a street
        return []
    side = "f" if front else "b"
    out = [f"{side}:{kind}", f"{side}:{kind}:{len(words)}", f"{side}:{kind}:comma={comma}", f"{side}:{kind}:caps={caps == len(words)}", f"num={shape(number)}", f"inner={sum(w in STREET_END for w in low[:-1])}"]
    if front:
        out.append(f"f:next={'cap' if longer_right[:1].isupper() else 'low' if longer_right[:1].isalpha() else 'none'}:{kind}")
        out.append(f"nextend={longer_right.casefold() in STREET_END}")
    else:
        out.append(f"b:prev={'cap' if longer_left[:1].isupper() else 'low' if longer_left[:1].isalpha() else 'none'}:{kind}")
        out.append(f"prevstart={longer_left.casefold() in STREET_START}")
    out.append(f"firstcap={words[0][0].isupper()}:{side}")
    out.append(f"lastcap={words[-1][0].isupper()}:{side}")
    return out


def _cjk_feats(sh: str, from_start: bool, to_end: bool, space: bool, n: int) -> list[str]:
    return ["cjk", "cjk=" + re.sub(r"(.)\1+", r"\1", sh), f"cjkfull={from_start}{to_end}", f"cjkspace={space}:{' ' in sh}", f"cjkn={n}"]


def _run_spans(classes: str, seps: tuple[str, ...], short: bool) -> list[tuple[int, int, list[str]]]:
    """First word, last word and features of the name spans of a run of words, by their classes and separators.

    ``short``: one of the first two words has fewer than three letters.
    """
    out, size = [], len(classes)
    if size == 1 and classes not in "GFBgfb":
        return out
    for i in range(size):
        reverse = classes[i] == "p" and any("," in s for s in seps[i : i + 4])
        lower = classes[i] == "l" and i + 1 < size and classes[i + 1] in "gf"
        plain = i == 0 and classes[:2] == "ll" and not short  # unlisted, in small letters
        if classes[i] not in "GFBUAigfb" and not reverse and not lower and not plain:
            continue
        for j in range(i, min(i + 6, size)):
            c = classes[j]
            if c not in "GFBUAigfbp" and not (c == "l" and (j == i or plain and j == 1 or any(x in "gfb" for x in classes[i:j]))):
                break
            if c in "pi" and j > i:
                continue
            between = seps[i:j]
            if sum("," in s for s in between) > 1 or any(s not in (" ", "-", ", ", "\u00a0", "\u3000") for s in between):
                break
            if j == i and c not in "GFBgfb":
                continue
            pat = classes[i] + "".join({" ": " ", "-": "-", ", ": ","}.get(s, "_") + x for s, x in zip(between, classes[i + 1 : j + 1]))
            known = sum(x in "GFBgfb" for x in classes[i : j + 1])
            lc, rc = classes[i - 1] if i else "^", classes[j + 1] if j + 1 < size else "$"
            ls, rs = seps[i - 1] if i else "", seps[j] if j + 1 < size else ""
            coarse = re.sub("[GFB]", "K", pat)
            out.append((i, j, [
                "pat=" + pat, "coarse=" + re.sub("[KUA]", "N", coarse), f"known={min(known, 3)}", f"known={min(known, 3)}/{j - i + 1}",
                "lc=" + lc, "rc=" + rc, f"lcs={lc}{ls}", f"rcs={rs}{rc}", f"n={j - i + 1}",
                "first=" + classes[i], "last=" + c, f"comma={',' in ''.join(between)}:{known > 0}",
            ]))
    return out


def _numbers(s: str, first: bool, inner: Callable) -> Iterator[tuple]:
    """(start, end, kind, inside) of the spans of a run of digits, ``first`` if it starts its line."""
    a, b = 0, len(s)
    pieces = [(a, b, s, False)]
    if s[0] == "(" and ")" not in s or s[0] == "+" and first:  # an opening bracket of the text, a mark of the line
        a, s = a + 1, s[1:]
        pieces.append((a, b, s, True))
    lead = re.match(r"[A-Z]{1,2}[ -]?", s)
    trail = re.search(r"[ ][A-Z]$", s)
    if lead:
        pieces.append((a + lead.end(), b, s[lead.end() :], True))
    if trail:
        pieces.append((a, b - 2, s[:-2], True))
    for x, y, t, cut in pieces:
        key = _digit_key(t, cut)
        yield x, y, "phone", inner("phone", _digit_feats, *key)
        yield x, y, "identity", inner("identity", _digit_feats, *key)


def _names(text: str, gaz: Gazetteer, run_spans: Callable) -> Iterator[tuple]:
    """(start, end, inside, first word, last word) of the names in a run of words; the words are named where they are in no list."""
    class_of = gaz.classes.__getitem__
    if text.isalpha():  # one word
        k = class_of(text)
        if k in "GFBgfb":
            for *_, x in run_spans(k, (), False):
                yield 0, len(text), x, "", ""
        return
    toks = None
    if text.replace(" ", "").isalpha():  # single spaces, and nothing else
        names = text.split(" ")
        seps = (" ",) * (len(names) - 1)
    else:
        toks = []
        for m in _NAME_WORD.finditer(text):
            a, b, w = m.start(), m.end(), m[0]
            # a full stop belongs to a word only after an initial or a short title
            if w[-1] == "." and len(w) > 2 and w[:-1].casefold() not in TITLES:
                b, w = b - 1, w[:-1]
            if len(w) > 3 and w[-1] == "s" and w[-2] in "'’":
                b, w = b - 2, w[:-2]
            toks.append((a, b))
        names = [text[a:b] for a, b in toks]
        seps = tuple([text[x[1] : y[0]] for x, y in zip(toks, toks[1:])])
    classes = "".join(map(class_of, names))
    for i, j, x in run_spans(classes, seps, len(names) > 1 and (len(names[0]) < 3 or len(names[1]) < 3)):
        if toks is None:
            ends = list(accumulate(len(w) + 1 for w in names))
            toks = [(e - len(w) - 1, e - 1) for e, w in zip(ends, names)]
        yield toks[i][0], toks[j][1], x, names[i].casefold() if classes[i] in "UAl" else "", names[j].casefold() if classes[j] in "UAl" and j > i else ""


def _named(text: str, gaz: Gazetteer) -> list[tuple[int, int, list[str]]]:
    """(start, end, features) of the names in a run of words."""
    return [(a, b, [*x, *[f"w0={first}"] * bool(first), *[f"wn={last}"] * bool(last)]) for a, b, x, first, last in _names(text, gaz, _run_spans)]


def _spans(line: str, words: list[str], gaz: Gazetteer, inner: Callable, numbers: Callable, names: Callable) -> Iterator[tuple]:
    """(start, end, kind, inside) of all spans worth scoring.

    ``words`` are the line's runs of letters, case folded. ``inner(kind, feats, *key)`` values the features of a span's inside,
    ``numbers(text, first)`` gives (start, end, kind, inside) of the spans of a run of digits, ``names(text, gaz)`` (start, end, inside) of
    the names in a run of words.
    """
    plain = line.isascii()
    wide = line if plain else line.translate(_WIDE)
    coded = wide.encode()
    digits = len(coded) - len(coded.translate(None, b"0123456789"))
    mails = [m for form in _MAILS for m in form.finditer(line)] if "@" in line or "at" in words or "＠" in line else ()
    for m in mails:
        s = m[1] if m.re is _MAILS[1] else m[0]
        b = m.start() + len(s)
        if m.re is _MAILS[1] and not re.search(r"[ (\[{](?:dot|DOT)[ )\]}]", s):
            continue
        yield m.start(), b, "email", inner("email", _email_feats, s, False)
        lead = re.match(r"[.%+-]+", s)
        if lead and lead.end() < len(s):
            yield m.start() + lead.end(), b, "email", inner("email", _email_feats, s[lead.end() :], True)
    for m in _DIGITS.finditer(wide) if digits > 5 else ():
        at = m.start()
        for x, y, kind, v in numbers(m[0], at == 0):
            yield at + x, at + y, kind, v
    if digits and (not plain or not _STREETS.isdisjoint(words) or not _TAILS.isdisjoint([w[-3:] for w in words])) and _HOUSE_BESIDE.search(line):
        for m in _FRONT.finditer(line):
            near, at = m[3].split(" "), m.start(3)
            for k in range(1, len(near) + 1):
                end = at + sum(map(len, near[:k])) + k - 1
                stop = near[k - 1].endswith(".")  # a full stop ends the text, not the street
                yield m.start(), end - stop, "address", inner("address", _address_feats, (*near[: k - 1], near[k - 1].rstrip(".")), True, bool(m[2]), m[1], "", near[k] if k < len(near) else "")
        for m in _BACK.finditer(line):
            near, at = m[1].split(" "), m.start(1)
            for k in range(len(near)):
                yield at + sum(map(len, near[:k])) + k, m.end(), "address", inner("address", _address_feats, tuple(near[k:]), False, bool(m[2]), m[3], near[k - 1] if k else "", "")
    for m in (_RUN if not gaz.parts.isdisjoint(words) else _ASCII_RUN if plain else _LONG_RUN).finditer(line):
        spans = names(m[0], gaz)
        if spans:
            at = m.start()
            for i, j, x in spans:
                yield at + i, at + j, "name", x
    if not plain and _CJK.search(line):
        for m in _CJK_NAME.finditer(line):
            space = " " in m[0] or "\u3000" in m[0]
            for a in range(m.start(), m.end() - 1):
                for b in range(a + 2, min(m.end(), a + 9) + 1):
                    s = line[a:b]
                    if s[0].isspace() or s[-1].isspace() or not "\u4e00" <= s[0] <= "\u9fff":
                        continue
                    sh = "".join(" " if x.isspace() else "k" if "\u4e00" <= x <= "\u9fff" or x == "々" else "h" for x in s)
                    yield a, b, "name", inner("name", _cjk_feats, sh, a == m.start(), b == m.end(), space, b - a)


def candidates(line: str, gaz: Gazetteer) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of all spans worth scoring, by start."""
    out, words = [], _words(line)
    shared = _line(words)
    inner = lambda kind, feats, *key: feats(*key)
    for a, b, kind, inside in _spans(line, words, gaz, inner, lambda text, first: _numbers(text, first, inner), _named):
        if inside:
            (l1, left), (r1, right) = _left(line[max(0, a - NEAR) : a]), _right(line[b : b + NEAR])
            out.append((a, b, kind, [f"{kind}:{f}" for f in [*shared, *inside, *left, *right, f"lr={l1}|{r1}"]]))
    out.sort(key=lambda c: (c[0], c[1]))
    return out


# ---- the model ----------------------------------------------------------------------------

# kinds that share a place ask for its features one after another
_left_of, _right_of = lru_cache(64)(_left), lru_cache(64)(_right)


class Model:
    """Weights by feature, and the scores of what lines share, kept for the lines to come.

    A span scored below ``floor[kind]`` is in no best segmentation: taking it out costs its
    score and changes at most the transitions around it, whose largest gain is ``-floor``. The
    candidates of a line have neighbours of the kinds proposed there only (``floors``), and none
    where all of them share a place (``alone``). A span is left unscored on the right where even
    the largest right side could not lift it to the floor, so decoding gives what scoring every
    candidate gives.
    """

    def __init__(self, weights: dict[str, float]):
        self.w = weights
        self.by_kind: dict[str, dict[str, float]] = {k: {} for k in [*KINDS, "trans"]}
        for f, v in weights.items():
            kind, _, rest = f.partition(":")
            self.by_kind[kind][rest] = v
        self.trans = {p: {k: weights.get(f"trans:{p}>{k}", 0.0) for k in KINDS} | {"$": 0.0} for p in ["", *KINDS]}
        self.floor = self._floor(KINDS)
        self.floors = lru_cache(1 << len(KINDS))(self._floor)
        self.alone = {k: -self.trans[""][k] - 1e-9 for k in KINDS}
        self.most_in = {k: max(self.trans[p][k] for p in self.trans) for k in KINDS}
        self.most_right = {k: self._most(k, "r1", "r2", "rw", "re", "rcue", "lr") for k in KINDS}
        self.most_beside = {k: self.most_right[k] + self._most(k, "l1", "l2", "l3", "lw", "le", "lb", "lcue", "lspace") for k in KINDS}
        self.most_around = {k: self.most_beside[k] + self._most(k, "bias", "head", "cue") for k in KINDS}
        self.most_named = self.most_around["name"] + self._most("name", "w0", "wn")
        self.inner = lru_cache(CACHED)(self._inner)
        self.left = lru_cache(CACHED)(self._left)
        self.right = lru_cache(CACHED)(self._right)
        self.run_spans = lru_cache(CACHED)(self._run_spans)
        self.numbers = lru_cache(CACHED)(self._numbers)
        self.names = lru_cache(CACHED)(self._names)
        self.shared = lru_cache(CACHED)(self.part)

    def _floor(self, kinds: Iterable[str]) -> dict[str, float]:
        """By kind, the least score of a span in a best segmentation of spans of some kinds."""
        return {k: -max(self.trans[p][k] + self.trans[k][n] - self.trans[p][n] for p in ["", *kinds] for n in [*kinds, "$"]) - 1e-9 for k in kinds}

    def _most(self, kind: str, *templates: str) -> float:
        """The largest score that features of some templates can have together."""
        sums, best = {"cue", "lcue", "rcue", "lb"}, dict.fromkeys(templates, 0.0)  # several of these can hold at once
        for f, v in self.by_kind[kind].items():
            t = f.split("=")[0]
            if t in best and v > 0:
                best[t] = max(best[t], 2 * v if t == "lb" else v) if t not in sums or t == "lb" else best[t] + v
        return sum(best.values())

    @classmethod
    def load(cls, path: str = WEIGHTS) -> Model:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def __reduce__(self):
        return Model, (self.w,)

    def score(self, feats: list[str]) -> float:
        w = self.w
        return sum(w[f] for f in feats if f in w)

    def part(self, kind: str, feats: list[str]) -> float:
        """The score of some of a span's features, named without its kind."""
        w, v = self.by_kind[kind], 0.0
        for f in feats:
            v += w.get(f, 0.0)
        return v

    def _inner(self, kind: str, feats: Callable, *key) -> float | None:
        made = feats(*key)
        v = self.part(kind, made) if made else -inf
        return v if v + self.most_around[kind] >= self.floor[kind] else None

    def _left(self, kind: str, left: str) -> tuple[str, float]:
        l1, feats = _left_of(left)
        return l1, self.part(kind, feats)

    def _right(self, kind: str, right: str) -> tuple[str, float]:
        r1, feats = _right_of(right)
        return r1, self.part(kind, feats)

    def _run_spans(self, classes: str, seps: tuple[str, ...], short: bool) -> list[tuple[int, int, float]]:
        scored = [(i, j, self.part("name", feats)) for i, j, feats in _run_spans(classes, seps, short)]
        return [(i, j, v) for i, j, v in scored if v + self.most_named >= self.floor["name"]]

    def _cached_run(self, classes: str, seps: tuple[str, ...], short: bool) -> list[tuple[int, int, float]]:
        return (self.run_spans if len(classes) < NEAR else self._run_spans)(classes, seps, short)

    def _numbers(self, text: str, first: bool) -> tuple[tuple[int, int, str, float], ...]:
        return tuple([x for x in _numbers(text, first, self.inner) if x[3] is not None])

    def _names(self, text: str, gaz: Gazetteer) -> tuple[tuple[int, int, float], ...]:
        w = self.by_kind["name"]
        scored = [(a, b, v + w.get("w0=" + first, 0.0) + w.get("wn=" + last, 0.0)) for a, b, v, first, last in _names(text, gaz, self._cached_run)]
        return tuple([x for x in scored if x[2] + self.most_around["name"] >= self.floor["name"]])

    def _cached_names(self, text: str, gaz: Gazetteer) -> tuple[tuple[int, int, float], ...]:
        return (self.names if len(text) < 4 * NEAR else self._names)(text, gaz)

    def spans(self, line: str, gaz: Gazetteer) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) of the candidates that a best segmentation can hold, by start."""
        words = _words(line)
        found = [c for c in _spans(line, words, gaz, self.inner, self.numbers, self._cached_names) if c[3] is not None]
        if not found:
            return found
        if len(found) == 1 or max([c[0] for c in found]) < min([c[1] for c in found]):  # no two of them can stand together
            floor = self.alone
        else:
            floor = self.floors(tuple(sorted({c[2] for c in found})))
        out, last, lines = [], "", _line(words)
        for a, b, kind, v in found:
            if kind != last:
                last, least, shared, beside, beyond = kind, floor[kind], self.shared(kind, lines), self.most_beside[kind], self.most_right[kind]
            v += shared
            if v + beside < least:
                continue
            l1, left = self.left(kind, line[a - NEAR : a] if a > NEAR else line[:a])
            v += left
            if v + beyond < least:
                continue
            r1, right = self.right(kind, line[b : b + NEAR])
            v += right + self.by_kind[kind].get(f"lr={l1}|{r1}", 0.0)
            if v >= least:
                out.append((a, b, kind, v))
        if len(out) > 1:
            out.sort(key=lambda c: (c[0], c[1]))
        return out

    def decode(self, line: str, gaz: Gazetteer) -> list[tuple[int, int, str]]:
        """The best set of non-overlapping spans of one line."""
        return self.best(self.spans(line, gaz))

    def best(self, spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
        if not spans or all(v + self.most_in[k] <= 0 for *_, k, v in spans):  # no span can add anything
            return []
        # state: kind of the last span ("" at the start of the line)
        ends: dict[int, list] = {}
        for c in spans:
            ends.setdefault(c[1], []).append(c)
        points = sorted({0, *(a for a, *_ in spans), *ends})
        best: dict[int, dict[str, tuple[float, tuple | None]]] = {}
        prev = None
        for p in points:
            here = dict(best[prev]) if prev is not None else {"": (0.0, None)}
            for a, b, k, s in ends.get(p, ()):
                for last, (v, back) in best[a].items():
                    t = v + s + self.trans[last][k]
                    if k not in here or t > here[k][0]:
                        here[k] = (t, ((a, b, k), back))
            best[p] = here
            prev = p
        back, found = max(best[prev].values(), key=lambda x: x[0])[1], []
        while back:
            found.append(back[0])
            back = back[1]
        return found[::-1]


def _alike(text: str) -> str:
    """A text with 2 for each digit from 2 to 9; no feature tells these apart."""
    for digit in "3456789":
        text = text.replace(digit, "2")
    if not text.isascii():
        for digit in "３４５６７８９":
            text = text.replace(digit, "２")
    return text


def decoder(model: Model, gaz: Gazetteer) -> Callable[[str], Sequence[tuple[int, int, str]]]:
    """``model.decode`` with one name list; lines that repeat are decoded once."""
    whole = lambda line: model.decode(line, gaz) or ()
    kept = lru_cache(2 * CACHED)(whole)
    return lambda line: kept(line) if len(line) < LONG else whole(line)


def spans_of(text: str, decode: Callable[[str], Sequence[tuple[int, int, str]]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal information in a text, in order. Lines that repeat but for their digits are the same line to ``decode``."""
    out, at = [], 0
    for raw in _alike(text).split("\n"):
        line = raw.rstrip("\r")
        if line and (found := decode(line)):
            out += [(at + a, at + b, kind) for a, b, kind in found]
        at += len(raw) + 1
    return out


def name_rows(name_parts: DataFrame) -> list[tuple[str, str]]:
    """The list of name parts, a table of people's names and not of the corpus; it goes to the workers by one broadcast."""
    rows = name_parts.select("name_part", "role").where(F.col("name_part").isNotNull()).distinct().collect()
    return sorted((r[0], r[1] or "") for r in rows)


def _spread(docs: DataFrame) -> DataFrame:
    """A table of fewer splits than cores is dealt out to all of them; larger ones are read as they lie."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    texts = docs.select("doc_id", "text")
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        yield b, b.column("text").to_pylist()


def find(docs: DataFrame, name_parts: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, kind, pii``: each distinct piece of personal information per document."""
    shared = docs.sparkSession.sparkContext.broadcast(((model or Model.load()).w, name_rows(name_parts)))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rows = shared.value
        decode = decoder(Model(weights), Gazetteer.of(rows))
        for b, texts in _texts(batches):
            at, kinds, found = [], [], []
            for i, text in enumerate(texts):
                if text:
                    for kind, s in dict.fromkeys((k, text[x:y]) for x, y, k in spans_of(text, decode)):
                        at.append(i)
                        kinds.append(kind)
                        found.append(s)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(found, pa.string())], ["doc_id", "kind", "pii"]
            )

    return _spread(docs).mapInArrow(run, f"doc_id {id_type.simpleString()}, kind string, pii string")


def redact(docs: DataFrame, name_parts: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, text`` with every span replaced by the placeholder of its kind."""
    shared = docs.sparkSession.sparkContext.broadcast(((model or Model.load()).w, name_rows(name_parts)))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rows = shared.value
        decode = decoder(Model(weights), Gazetteer.of(rows))
        for b, texts in _texts(batches):
            out = []
            for text in texts:
                if text:
                    parts, last = [], 0
                    for x, y, k in spans_of(text, decode):
                        parts += [text[last:x], PLACEHOLDER[k]]
                        last = y
                    text = "".join([*parts, text[last:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return _spread(docs).mapInArrow(run, f"doc_id {id_type.simpleString()}, text string")
