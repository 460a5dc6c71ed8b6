"""Problem 9: personal information inside free text, replaced by typed placeholders.

Method: anchor expansion. One Aho-Corasick automaton runs over each text and finds the anchors:
at-signs and their spelled-out forms, digit pairs, the second halves of British postcodes, labels of identity records, listed given names,
initials, titles, words that announce a person, and endings of family names. From each anchor a deterministic local parser expands to both
sides and validates what it has found: e-mail addresses by the form of their domain, phone numbers by the known layouts of digits, identity
numbers by their label and layout, addresses from their postcode by town, house number and street, names by a given name or
initials beside a word that is no word of the lexicon. Nothing is looked for away from an anchor. Of overlapping finds the kind that comes first in
``KINDS`` wins, then the longer one.

The tables ``given_names`` and ``lexicon`` are small and fixed (at most ``MAX_WORDS`` rows of each are read; more raise an
error); they are incomplete, so an unknown capitalised word counts as a given name where a title or an announcing
word stands before it or where both words of the pair are unknown, and as a family name wherever the lexicon doesn't know it.
What all documents say about a word decides doubtful pairs only (``learn``): endings of family names, where no listed given name and no
title stands before the word, and products named after a given name, such as a fixed second word that follows one given name nearly always.

Defined results: null and empty texts stay as they are and give no finds; repeated rows are texts of their own; finds of one row
are distinct (kind, text) pairs in ``found``; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage

KINDS = ("email", "id_number", "address", "phone", "name")
MAX_WORDS = 100_000
ENDING = 3  # letters of a family name's ending
GIVEN_PER_ENDING = 3  # different given names that must precede an ending
ENDING_SHARE = 0.1  # and so many of those that precede the best ending, so that chance finds in large tables don't count
PRODUCT_USES = 10  # documents with a given name and a fixed second word that make a product
PRODUCT_SHARE = 0.95  # share of those in all that have the second word where a family name may stand

# Words of the local parsers.
AT_WORDS = ("at", "arroba", "arobase", "ät", "chez")
DOT_WORDS = ("dot", "punkt", "punto", "point")
ID_LABELS = (
    "ssn", "social security number", "social security no", "nir", "dni", "nie", "nif", "personalausweis", "ausweisnummer", "identity card", "id card",
    "steuer-id", "steuer-idnr", "steueridentifikationsnummer", "national insurance number", "national insurance no", "nino", "passport no", "passport number", "passport",
    "reisepass", "pasaporte", "passeport", "tax id", "tax number", "numéro fiscal", "número fiscal", "numéro de sécurité sociale", "insee",
)
TITLES = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "herrn", "frau", "m", "mme", "mlle", "monsieur", "madame", "sr", "sra", "srta", "don", "doña", "señor", "señora",
)
ANNOUNCING = (
    "author", "by", "cc", "ask", "owner", "contact", "from", "to", "signed", "regards", "grüßen", "grüße", "cordialement", "saludos", "von", "durch", "par", "por", "a", "à",
    "bitte", "demandez", "pregunte", "maintainer", "autor", "auteur", "name", "nombre", "nom", "assignee", "reviewer", "__author__",
)
PARTICLES = "van der|van den|van de|van|von der|von|zu|de la|de los|de las|de l'|de|del|della|du|di|da|dos|af|el|la|le|ter|ten"

_L = r"[^\W\d_]"
_UP = "[A-ZÀ-ÖØ-ÞĄĆČĎĐĘĚĞİŁŃŇŐŘŚŞŠŤŰŹŻŽ]"
_CAP = rf"(?:[OD]['’](?={_UP}))?{_UP}[\w'’]*{_L}"
_FAMILY = rf"{_CAP}(?:[-‐‑]{_CAP})*"
_GAP = r"(?:[ \t ]{1,3}|[ \t]*\r?\n[ \t]*)"
_INITIALS = rf"{_UP}\.(?:[ \t]?-?{_UP}\.)*"

_NAME_AFTER_GIVEN = re.compile(rf"(?:{_GAP}(?P<middle>{_INITIALS}))?(?:{_GAP}(?i:{PARTICLES}))?{_GAP}(?P<family>{_FAMILY})(?![\w@])")
_NAME_BY_INITIALS = re.compile(rf"(?<![\w.@-])(?P<initials>{_INITIALS})(?:{_GAP}(?i:{PARTICLES}))?(?:{_GAP}|)(?P<family>{_FAMILY})(?![\w@])")
_NAME_REVERSED = re.compile(rf"(?<![\w@.-])(?P<lead>(?:(?i:{PARTICLES}){_GAP})?)(?P<family>{_FAMILY}),{_GAP}(?P<given>{_CAP}(?:-{_CAP})?|{_INITIALS})(?:{_GAP}(?P<middle>{_UP}\.))?(?![\w@])")
_PAIR = re.compile(rf"(?<![\w@.&/'’-])(?P<given>{_CAP}(?:-{_CAP})?)(?=(?:{_GAP}{_INITIALS})?(?:{_GAP}(?i:{PARTICLES}))?{_GAP}(?:{_CAP}))")

_LOCAL = r"[^\W_](?:[\w.%+-]*[\w])?"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_AT = rf"(?:[ \t]?@[ \t]?|[ \t]*[(\[{{<][ \t]*(?:@|{'|'.join(AT_WORDS)})[ \t]*[)\]}}>][ \t]*|[ \t]+(?:{'|'.join(AT_WORDS)})[ \t]+)"
_DOT = rf"(?:\.|[ \t]*[(\[{{<][ \t]*(?:\.|{'|'.join(DOT_WORDS)})[ \t]*[)\]}}>][ \t]*|[ \t]+(?:{'|'.join(DOT_WORDS)})[ \t]+)"
_EMAIL = re.compile(rf"(?<![\w.%+-])(?P<local>{_LOCAL}(?:{_DOT}{_LOCAL})*?)(?P<at>{_AT})(?P<domain>{_LABEL}(?:{_DOT}{_LABEL})+)(?![\w])", re.I)

_COUNTRY = re.compile(r"\+\d{1,3}[ .-]?$")
_PHONES = [
    re.compile(p)
    for p in (
        r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}",
        r"\+44[ .-]?(?:\(0\)[ .-]?)?\d{2,4}[ .-]?\d{3,4}[ .-]?\d{3,4}",
        r"\+33[ .-]?(?:\(0\)[ .-]?)?[1-9](?:[ .-]?\d{2}){4}",
        r"\+34[ .-]?\d{3}(?:[ .-]?\d{2}){3}",
        r"\+34[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{3}",
        r"\+49[ .-]?(?:\(0\)[ .-]?)?\d{2,5}[ ./-]{0,3}\d{3,8}(?:[ .-]?\d{1,5})?",
        r"\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}",
        r"00[1-9]\d[ .-]?(?:\(0\)[ .-]?)?\d{1,5}(?:[ ./-]{0,3}\d{2,8}){1,4}",
        r"\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}",
        r"\d{3}([ .-])\d{3}\1\d{4}",
        r"0\d([ .-])\d{2}(?:\1\d{2}){3}",
        r"0\d{9,10}",
        r"0\d{2,4}[ ]?/[ ]?\d{3,8}(?:[ -]?\d{1,5})?",
        r"\(0\d{2,4}\)[ ]?\d{3,8}(?:[ -]?\d{1,5})?",
        r"020[ ]\d{4}[ ]\d{4}",
        r"0\d{2,4}[ -]\d{5,8}(?:[ -]\d{1,4})?",
        r"[5-9]\d{2}(?:[ ]\d{2}){3}",
    )
]

_ID_NUMBERS = [
    re.compile(p)
    for p in (
        r"[12][ ]?\d{2}[ ]?\d{2}[ ]?(?:\d{2}|2[AB])[ ]?\d{3}[ ]?\d{3}(?:[ ]?\d{2})?",
        r"\d{3}[- ]\d{2}[- ]\d{4}",
        r"[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z]",
        r"\d{4}[ -]\d{4}[ -]\d{4}",
        r"\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}",
        r"[XYZ]?-?\d{7,8}-?[A-Z]",
        r"[A-Z]{1,2}[ ]?\d{6,8}",
        r"(?=[A-Z0-9]*\d)[A-Z0-9]{8,12}",
        r"\d{9,12}",
    )
]
_AFTER_LABEL = re.compile(r"(?:[ -]?(?:no|nr|number|num|nummer|n°|nº|núm)\b\.?)?[.]?[ \t]*[:#=]?(?:[ \t]+|[ \t]*\r?\n[ \t]*|)", re.I)

_TOWN = rf"{_CAP}(?:[-' ’][A-Za-zÀ-ÿ][\w'’]*){{0,3}}?"
_NUMBER = r"\d{1,4}(?:[ ]?[a-zA-Z]\b|[ ](?:bis|ter|quater)\b)?"
_BREAK = r"(?:,[ \t]*\r?\n?[ \t]*|[ \t]*\r?\n[ \t]*)"
_POSTCODE = r"(?:\d{5}|[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2})"
_UNIT = rf"(?:{_BREAK}(?i:flat|apt\.?|apartment|unit|suite|bât\.?|appt\.?|étage|piso|pta\.?|puerta|esc\.?|whg\.?|wohnung|hinterhaus|\d{{1,2}}[ºª°])[ ]?[\w ºª°.-]{{0,12}}?)?"
_STREETS = [
    rf"{_NUMBER},?[ ](?:{_CAP}[ ]){{1,3}}(?:Road|Street|St|Lane|Avenue|Ave|Terrace|Crescent|Close|Way|Drive|Court|Gardens|Square|Hill|Row|Walk|Place|Mews|Grove|Rd|Ln|Dr)\b\.?",
    rf"{_NUMBER},?[ ](?:[Rr]ue|[Aa]venue|[Aa]v\.|[Ii]mpasse|[Bb]oulevard|[Bb]d\.?|[Aa]llée|[Aa]llées|[Cc]hemin|[Pp]lace|[Qq]uai|[Cc]ours|[Rr]oute|[Pp]assage|[Ss]entier|[Ss]quare|[Vv]enelle|[Ff]aubourg)[ ][\w'’ -]{{2,40}}?",
    rf"(?:{_CAP}(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm|steig|graben|hof|markt|pfad|chaussee|wall|tor|zeile)|{_CAP}[ ](?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ufer|Ring|Damm|Chaussee)|(?:Am|An|Im|In|Auf|Zum|Zur|Unter|Hinter|Beim)[ ](?:(?:der|dem|den|die|das)[ ])?(?:{_CAP}[ ]?){{1,3}})[ ]?{_NUMBER}",
    rf"(?:C/|Calle|c/|Avda\.|Avenida|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carrera|Cuesta|Glorieta|Callejón)[ ]?[\w'’ .-]{{2,40}}?,?[ ]{_NUMBER}",
]
_ADDRESS = re.compile("|".join(rf"(?:(?<![\w/.-])(?:{s}){_UNIT}{_BREAK}(?:{_POSTCODE}[ ]{_TOWN}|{_TOWN},?[ ]{_POSTCODE})(?!\w))" for s in _STREETS))
_POSTCODE_BEFORE = re.compile(r"[A-Z]{1,2}\d[A-Z\d]?$")  # the first half of a British postcode

# Expansion of name anchors to the left: the word that an ending closes, the given name before a family name, the family name before a comma.
_WORD_BEFORE = re.compile(r"[\w'’]+(?:[-‐‑][\w'’]+)*$")
_GIVEN_BEFORE = re.compile(rf"(?P<given>[\w'’-]+)(?:{_GAP}{_INITIALS})?(?:{_GAP}(?i:{PARTICLES}))?{_GAP}$")
_LEAD_BEFORE = re.compile(rf"(?<![\w@.-])(?i:{PARTICLES}){_GAP}$")
_FAMILY_BEFORE = re.compile(rf"(?<![\w@.-])(?:(?i:{PARTICLES}){_GAP})?{_FAMILY},{_GAP}$")
_TO_NEXT_WORD = re.compile(r"[\W_]{1,4}(?=\w)")
_LEFT = 90  # characters a name anchor expands to the left, at most


class Finder:
    """Finds personal information in a text."""

    def __init__(self, given: list[str], words: list[str], endings: frozenset[str] = frozenset(), products: frozenset[tuple[str, str]] = frozenset()):
        import ahocorasick

        self.endings = endings
        self.products = products

        self.given = {g.lower() for g in given}
        self.words = set(words)
        anchors: dict[str, str] = {"@": "email"}
        for w in AT_WORDS:
            anchors |= {f" {w} ": "email", f"({w})": "email", f"[{w}]": "email", f"( {w} )": "email", f"{{{w}}}": "email", f"<{w}>": "email"}
        anchors |= {f"{i:02d}": "digits" for i in range(100)}
        anchors |= {label: "id" for label in ID_LABELS}
        anchors |= {f" {d}{c}": "postcode" for d in range(10) for c in string.ascii_lowercase}
        anchors |= {f"{c}.": "initial" for c in {c.lower() for c in map(chr, range(65, 0x180)) if re.fullmatch(_UP, c)}}
        self.anchors = ahocorasick.Automaton()
        words_of_names = [(w, "announcer") for w in (*TITLES, *ANNOUNCING)] + [(g, "given") for g in self.given] + [(e, "ending") for e in endings]
        for word, kind in (*anchors.items(), *words_of_names):
            # a word may be an anchor of several kinds
            self.anchors.add_word(word, (*self.anchors.get(word, ()), (kind, len(word))))
        self.anchors.make_automaton()

    def _unknown(self, word: str) -> bool:
        """Whether the lexicon doesn't know the word, nor any of its hyphened parts."""
        low = word.lower()
        return low not in self.words and not any(p in self.words or (p.endswith("s") and p[:-1] in self.words) for p in re.split(r"[-‐‑]", low)) and len(word) > 2

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), in order, without overlaps."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer: keep the places
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        spans: list[tuple[int, int, str]] = []
        digit_end = id_end = mail_end = -1
        phone_at: list[int] = []
        postcodes: list[tuple[int, int]] = []
        given_at: set[int] = set()  # where a given name, initials or a name with its family first may begin
        initials_at: set[int] = set()
        reversed_at: set[int] = set()
        for end, hits in self.anchors.iter(low):
            for kind, size in hits:
                at = end - size + 1
                if kind == "email":
                    if at >= mail_end:
                        m = self._email(text, at, end + 1)
                        if m:
                            spans.append((*m, "email"))
                            mail_end = m[1]
                elif kind == "id":
                    if end + 1 > id_end and not (at and low[at - 1].isalnum()) and not low[end + 1 : end + 2].isalpha():
                        m = self._id_number(text, end + 1)
                        if m:
                            spans.append((*m, "id_number"))
                            id_end = m[1]
                elif kind == "digits":
                    if at > digit_end:
                        start = at
                        while start > 0 and text[start - 1].isdigit():
                            start -= 1
                        stop = end + 1
                        while stop < len(text) and text[stop].isdigit():
                            stop += 1
                        digit_end = stop - 1
                        phone_at.append(start)
                        if stop - start == 5:
                            postcodes.append((start, stop))
                elif kind == "postcode":
                    if text[at + 2 : at + 4].isupper() and text[at + 3 : at + 4].isalpha() and (m := _POSTCODE_BEFORE.search(text, max(0, at - 4), at)):
                        postcodes.append((m.start(), at + 4))
                elif kind == "ending":
                    if not low[end + 1 : end + 2].isalnum():
                        self._before_family(text, end + 1, given_at, reversed_at)
                elif kind == "given":
                    if not (at and low[at - 1].isalnum()) and not low[end + 1 : end + 2].isalnum():
                        start = at - len(m[0]) if text[at - 1 : at] == "-" and (m := re.search(r"\w+-$", text[max(0, at - 24) : at])) else at
                        given_at.add(start)
                        if m := _FAMILY_BEFORE.search(text, max(0, start - _LEFT), start):
                            reversed_at.add(m.start())
                elif kind == "initial":
                    if not (at and (low[at - 1].isalnum() or low[at - 1] in ".@-_")) and text[at].isupper():
                        initials_at.add(at)
                elif kind == "announcer" and not (at and low[at - 1].isalpha()) and (m := _TO_NEXT_WORD.match(text, end + 1)):
                    given_at.add(m.end())
                    reversed_at.add(m.end())
        self._addresses(text, postcodes, spans)
        taken = 0
        for at in phone_at:
            if at >= taken:
                m = self._phone(text, at)
                if m:
                    spans.append((*m, "phone"))
                    taken = m[1]
        self._names(text, spans, sorted(reversed_at), sorted(given_at), sorted(initials_at))
        return _resolve(spans)

    @staticmethod
    def _before_family(text: str, stop: int, given_at: set[int], reversed_at: set[int]) -> None:
        """Expands the ending of a family name, which stops there, to the words before it."""
        word = _WORD_BEFORE.search(text, max(0, stop - _LEFT), stop)
        if not word or not text[word.start()].isupper():
            return
        start = word.start()
        if m := _GIVEN_BEFORE.search(text, max(0, start - _LEFT), start):
            given_at.add(m.start("given"))
        lead = _LEAD_BEFORE.search(text, max(0, start - 16), start)
        reversed_at.add(lead.start() if lead else start)

    def _email(self, text: str, at: int, end: int) -> tuple[int, int] | None:
        lo = max(0, at - 100)
        for m in _EMAIL.finditer(text, lo, min(len(text), end + 140)):
            if m.start("at") <= at < m.end("at") or m.start("at") <= end - 1 < m.end("at"):
                domain = m["domain"]
                labels = re.split(_DOT, domain, flags=re.I)
                spelled = not ("@" in m["at"])
                if labels[-1].isdigit() or not re.fullmatch(rf"{_L}{{2,}}", labels[-1]):
                    return None
                if spelled and "." in domain and re.search(r"[(\[{<]", m["at"]) is None and not re.search("|".join(DOT_WORDS), domain, re.I):
                    return None
                start, stop = m.span()
                if spelled:  # words before a spelled-out address are not part of it
                    local = m["local"]
                    tail = re.search(r"\S+$", local)
                    if tail and not re.search(rf"(?:{'|'.join(DOT_WORDS)})", local, re.I):
                        start = m.start("local") + tail.start()
                return start, stop
            if m.start() > end:
                break
        return None

    def _id_number(self, text: str, after: int) -> tuple[int, int] | None:
        m = _AFTER_LABEL.match(text, after)
        at = m.end() if m else after
        for form in _ID_NUMBERS:
            n = form.match(text, at)
            if n and not text[n.end() : n.end() + 1].isalnum() and not re.match(r"[-/]\d", text[n.end() : n.end() + 2]):
                return n.span()
        return None

    def _addresses(self, text: str, postcodes: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> None:
        done = 0
        for start, stop in sorted(postcodes):
            if start >= done:
                for m in _ADDRESS.finditer(text, max(done, start - 120), min(len(text), stop + 60)):
                    if m.start() <= start < m.end():
                        end = self._town_end(text, m)
                        spans.append((m.start(), end, "address"))
                        done = end
                        break

    def _town_end(self, text: str, m: re.Match) -> int:
        """Takes further parts of a town's name that a hyphen or a small word joins to it."""
        end = m.end()
        if text[end - 1].isdigit() or re.search(r"\d[A-Z]{2}$", m.group()):
            return end
        more = re.compile(rf"(?:[ ](?:de|la|las|los|del|sur|sous|en|am|an der|le|les|ob der|upon|unter|bei))+[ ]({_CAP})")
        while (x := more.match(text, end)) and self._unknown(x[1]) and x[1].lower() not in self.given and not x[1].isupper():
            end = x.end()
        return end

    def _phone(self, text: str, at: int) -> tuple[int, int] | None:
        start = at
        if text[start - 1 : start] == "(":
            start -= 1
        if text[start - 1 : start] == "+":
            start -= 1
        elif m := _COUNTRY.search(text, max(0, start - 6), start):
            start = m.start()
        before = text[max(0, start - 1) : start]
        if before.isalnum() or before in set("-/.,#_:%$€£§\\") and not (before in ":.," and not text[max(0, start - 2) : start - 1].isdigit()):
            if before not in ("=",):
                return None
        for form in _PHONES:
            m = form.match(text, start)
            if m:
                nxt, after = text[m.end() : m.end() + 1], text[m.end() + 1 : m.end() + 2]
                digits = sum(c.isdigit() for c in m.group())
                if not (8 <= digits <= 15) or nxt.isalnum() or nxt == "_" or (nxt in "-./:" and nxt and after.isdigit()):
                    continue
                if nxt == " " and re.match(r" \d{2,}", text[m.end() : m.end() + 4]) and not text[start] == "+":
                    continue
                return m.span()
        return None

    def _known_ending(self, family: str) -> bool:
        """Whether the word ends as family names do here; anything does as long as no endings have been learned."""
        return not self.endings or any(p.lower()[-ENDING:] in self.endings for p in re.split(r"[-‐‑]", family))

    def _listed(self, given: str) -> bool:
        return given in self.given or ("-" in given and all(p in self.given for p in given.split("-")))

    def _names(self, text: str, spans: list[tuple[int, int, str]], reversed_at: list[int], given_at: list[int], initials_at: list[int]) -> None:
        taken = [(a, b) for a, b, _ in spans]

        def add(a: int, b: int) -> None:
            if not any(x < b and a < y for x, y in taken):
                spans.append((a, b, "name"))
                taken.append((a, b))

        at = 0
        for start in reversed_at:
            if start < at or not (m := _NAME_REVERSED.match(text, start)):
                continue
            at = m.start("given")  # what comes after the comma may be the family name of another match
            family, given, lead = m["family"], m["given"], m["lead"].strip().lower()
            low = family.lower()
            if low in ANNOUNCING or low in self.given or not self._unknown(family):
                continue
            # a lone "von" or "de" before the name may announce it instead of belonging to it
            announces = lead in ANNOUNCING and not self._announced(text, m.start())
            doubtful = not self._known_ending(family) and not self._announced(text, m.start(), TITLES)
            if given.lower() in self.given or (not doubtful and (given.endswith(".") or self._unknown(given)) and (lead or self._announced(text, m.start()))):
                add(m.start("family") if announces else m.start(), m.end())
                at = m.end()
        for start in given_at:
            if not (g := _PAIR.match(text, start)):
                continue
            low = g["given"].lower()
            m = _NAME_AFTER_GIVEN.match(text, g.end())
            if not m or low in TITLES or low in ANNOUNCING or not self._unknown(m["family"]):
                continue
            if self._listed(low):
                if (low, m["family"].lower()) not in self.products or self._announced(text, g.start(), TITLES):
                    add(g.start(), m.end())
            elif self._unknown(g["given"]):
                plain = m.start("family") - g.end() <= 4 or m["middle"]
                family_first = self.endings and low[-ENDING:] in self.endings  # then the second word belongs to what follows, unless it ends as a family name does
                if self._known_ending(m["family"]):
                    if self._announced(text, g.start()) or (plain and self.endings and not family_first):
                        add(g.start(), m.end())
                elif not family_first and self._announced(text, g.start(), TITLES):
                    add(g.start(), m.end())
        at = 0
        for start in initials_at:
            if start < at or not (m := _NAME_BY_INITIALS.match(text, start)):
                continue
            at = m.end()
            if self._unknown(m["family"]) and m["family"].lower() not in self.given:
                add(*m.span())

    def _announced(self, text: str, at: int, by: tuple[str, ...] = (*TITLES, *ANNOUNCING)) -> bool:
        before = re.search(r"([^\W\d]+)[\W_]{1,4}$", text[max(0, at - 24) : at])
        return bool(before) and before[1].strip("_").lower() in by

    def uses(self, text: str) -> set[tuple[str, str, bool]]:
        """(unknown word, listed given name before it or "", plain) of pairs whose second word may be a family name; plain: nothing but the given name says so."""
        out = set()
        for g in _PAIR.finditer(text):
            low = g["given"].lower()
            if low not in self.words and (m := _NAME_AFTER_GIVEN.match(text, g.end())) and self._unknown(m["family"]):
                if self._listed(low):
                    plain = text[g.end() : m.start("family")].isspace() and not self._announced(text, g.start())
                    out.add((m["family"].lower(), low, plain))
                else:
                    out.add((m["family"].lower(), "", False))
        return out


def _resolve(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0] - s[1], s[0])):
        if all(s[1] <= a or b <= s[0] for a, b, _ in kept):
            kept.append(s)
    return sorted(kept)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    return "".join((*out, text[at:]))


@lru_cache(maxsize=2)
def _finder(given: tuple[str, ...], words: tuple[str, ...], endings: tuple[str, ...] = (), products: tuple[tuple[str, str], ...] = ()) -> Finder:
    return Finder(list(given), list(words), frozenset(endings), frozenset(products))


def _uses(docs: DataFrame, given: tuple[str, ...], words: tuple[str, ...], text_col: str) -> DataFrame:
    """``(word, given, plain, docs)``: in how many of all documents ``Finder.uses`` sees each use of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(given, words)
        for b in batches:
            n = Counter(u for t in b.column(0).to_pylist() if t for u in finder.uses(t))
            cols = [pa.array([u[k] for u in n], type=kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n.values(), type=pa.int64())], names=["word", "given", "plain", "docs"])

    seen = docs.select(text_col).filter(F.col(text_col).isNotNull()).mapInArrow(run, "word string, given string, plain boolean, docs bigint")
    return seen.groupBy("word", "given", "plain").agg(F.sum("docs").alias("docs"))


def _endings(uses: DataFrame) -> tuple[str, ...]:
    n = uses.filter("given <> ''").groupBy(F.substring("word", -ENDING, ENDING).alias("ending")).agg(F.countDistinct("given").alias("given"))
    rows = n.filter(F.col("given") >= GIVEN_PER_ENDING).collect()
    best = max((r.given for r in rows), default=0)
    return tuple(sorted(r.ending for r in rows if r.given >= ENDING_SHARE * best))


def learn_endings(docs: DataFrame, given: tuple[str, ...], words: tuple[str, ...], text_col: str = "text") -> tuple[str, ...]:
    """Endings of family names: those that follow at least ``GIVEN_PER_ENDING`` different listed given names in all documents.

    Product names such as a given name with a fixed second word follow one given name only. At most as many values as there are triples of letters, in practice some dozens.
    """
    return _endings(_uses(docs, given, words, text_col))


def learn(docs: DataFrame, given: tuple[str, ...], words: tuple[str, ...], text_col: str = "text") -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """(endings of family names, (given name, second word) of products), from one count over all documents.

    A product's second word doesn't end as family names do, stands plainly after the one given name in at least ``PRODUCT_USES`` documents, and hardly
    ever (``PRODUCT_SHARE``) after another name or title or where a word announces the pair: few pairs at any size.
    """
    uses = cut_lineage(_uses(docs, given, words, text_col))
    endings = _endings(uses)
    of_word = uses.groupBy("word").agg(F.sum("docs").alias("all"), F.max(F.when(F.col("plain"), F.struct("docs", "given"))).alias("top"))
    rows = of_word.filter((F.col("top.docs") >= PRODUCT_USES) & (F.col("top.docs") >= F.col("all") * PRODUCT_SHARE)).select("top.given", "word").collect()
    return endings, tuple(sorted((r.given, r.word) for r in rows if not any(p[-ENDING:] in endings for p in re.split(r"[-‐‑]", r.word))))


def _small(df: DataFrame, column: str) -> tuple[str, ...]:
    rows = [r[0] for r in df.select(column).filter(f"{column} is not null").distinct().limit(MAX_WORDS + 1).collect()]
    if len(rows) > MAX_WORDS:
        raise ValueError(f"{column}: more than {MAX_WORDS} words; raise MAX_WORDS if executors can hold them")
    return tuple(sorted(rows))


def redact_texts(docs: DataFrame, given_names: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, redacted, finds array<struct<kind, found, start>>)`` of every row."""
    return _run(docs, given_names, lexicon, id_col, text_col, whole=True)


def found(docs: DataFrame, given_names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(doc_id, kind, found)``, distinct within a row."""
    return _run(docs, given_names, lexicon, "doc_id", "text", whole=False)


def _run(docs: DataFrame, given_names: DataFrame, lexicon: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    given, words = _small(given_names, "given_name"), _small(lexicon, "word")
    endings, products = learn(docs, given, words, text_col)
    kind_of_id = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(given, words, endings, products)
        item = pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string()), ("start", pa.int32())]))
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            spans = [finder.find(t) if t else [] for t in texts]
            if whole:
                red = [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                finds = [[{"kind": k, "found": t[a:z], "start": a} for a, z, k in s] for t, s in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(red, type=pa.string()), pa.array(finds, type=item)], names=[id_col, "redacted", "finds"])
            else:
                rows = [(i, k, f) for i, (t, s) in enumerate(zip(texts, spans, strict=True)) for k, f in dict.fromkeys((k, t[a:z]) for a, z, k in s)]
                take = pa.array([r[0] for r in rows], type=pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(take), pa.array([r[1] for r in rows], type=pa.string()), pa.array([r[2] for r in rows], type=pa.string())], names=[id_col, "kind", "found"])

    schema = f"`{id_col}` {kind_of_id}, " + ("redacted string, finds array<struct<kind: string, found: string, start: int>>" if whole else "kind string, found string")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
