"""Problem 4: prompt and answer pairs whose answer is no usable reply.

Method: an answer is divided into clauses (sentences, list items, code blocks) and a conditional random field tags
each as answer, refusal, echo, foreign, unfinished or stand-in. The shares of the tags make the pair's defect: ``empty`` if there
is no clause or nothing but stand-ins, ``copied`` if all is echo (framing counts as such) and the echo gives back the prompt, ``refusal`` if a refusal stands with
no answer of its own, ``other_language`` if most of the words are foreign, ``truncated`` if the last clause is unfinished.

The field is fitted on the driver to about ``SAMPLE`` rows (the bound is a parameter; the rows are chosen by a hash of their id), whose labels are
made: real answers that show no sign of a defect are kept, cut off, exchanged with another language's, replaced by their prompt or a stand-in, or preceded
or replaced by a refusal put together from ``REFUSALS``. The corpus itself is tagged by Spark tasks. A lexicon of more than ``MAX_WORDS`` words raises an error.

Defined results: a null prompt counts as empty (nothing can be copied, no language is asked for); rows with the same id
count once (the first of the equal ones, else the least answer); null ids are kept out; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.crf import ChainCrf
from lodestrata.session import wide

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished", "stand_in")
SAMPLE = 1500  # rows the field is fitted to, about
ECHOED = 0.8  # share of the prompt's words that a copy gives back
MAX_WORDS = 100_000  # of the lexicon, a small fixed table

# Words of four languages.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are it that this which with for on not no by as be was so what how why when who where you i my we they there but because then than its from at into after before without while although whereas please give me list every does do did has have can".split(),
    "de": "der die das den dem des ein eine einer einen einem und oder von zu im in ist sind es dass diese dieser dieses mit für auf nicht kein keine wie was warum wer wo sie wir ich mir man aber weil denn doch dann als aus bei nach vor ohne bis seit sowohl auch alles jede jeder wird werden hat haben kann bitte zur zum sondern noch hier".split(),
    "fr": "le la les un une des de du et ou à au aux est sont il elle ce cette ces que qui dans avec pour sur ne pas aucun aucune comment pourquoi quand où vous je mon nous on mais car parce puis depuis sans chaque toute avant après plus fait peut d l n s c qu donc".split(),
    "es": "el la los las un una unos de del y o en es son que este esta con para por no ni ninguna ningún cómo qué cuándo dónde quién usted yo mi nos se lo le pero porque luego desde sin cada toda antes después más hay hemos como tanto sino casi nunca ha".split(),
}
# Those of them that no sentence ends with.
NEVER_LAST = frozenset((
    "the a an and or of to with for by as at from into because which while although whereas than its every if so our their "
    "der die das den dem des ein eine einer einen einem und oder von zu im mit für dass weil denn doch bei sowohl zur zum sondern unsere jede jeder diese dieser "
    "le la les un une des de du et ou à au aux ce cette ces que qui dans avec pour car parce mais notre chaque donc si "
    "el los las una unos del y o con para por pero porque nuestra nuestro cada toda este esta sino tanto como que"
).split())
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|anglais|ingl[eé]s", "de": r"german|deutsch\w*|allemand|alem[aá]n", "fr": r"french|französisch\w*|fran[cç]ais|franc[eé]s",
    "es": r"spanish|spanisch\w*|espagnol|espa[nñ]ol|castellano", "zh": r"chinese|chinesisch\w*|chinois|chino|中文", "ja": r"japanese|japanisch\w*|japonais|japon[eé]s|日本語",
    "it": r"italian|italienisch\w*|italien|italiano", "pt": r"portuguese|portugiesisch\w*|portugais|portugu[eé]s",
}
STAND_INS = frozenset("n/a na none null nil nan undefined tbd todo empty keine nichts aucun aucune nada ninguna vacío vide leer blank unknown".split()) | {
    "no answer", "no response", "no reply", "no output", "keine antwort", "pas de réponse", "sin respuesta", "answer", "antwort", "réponse", "respuesta", "response", "br", "not available", "no content", "no data", "missing",
    "to be done", "to do", "empty answer", "leere antwort", "aucune réponse", "nan nan",
}
APOLOGY = r"\b(?:i'?m sorry|i am sorry|sorry|apolog\w+|pardon\w*|excuse\w*|unfortunately|regret\w*|entschuldig\w+|tut mir leid|leider|bedau\w+|désolée?|malheureusement|navrée?|lo siento|perdona|perdón|disculp\w+|lamento|lamentablemente|por desgracia|desafortunadamente)\b"
INABILITY = (
    r"(?:\b(?:can'?t|cannot|can not|can’t|unable|not able|won'?t|will not|won’t|not allowed|not permitted|not authori[sz]ed|don'?t feel|don’t feel|not comfortable|must decline|have to decline|decline|refuse|must refuse|against my|outside what i|not something i|beyond what i)\b"
    r"|\b(?:kann (?:ich|dir|ihnen|dabei|das|hier)|kann nicht|darf (?:ich|nicht)|darf ich|nicht beantworten|nicht helfen|ablehnen|nicht erlaubt|nicht befugt|nicht in der lage|außerstande|möchte ich nicht)\b"
    r"|\b(?:ne peux pas|ne puis|ne suis pas|ne pourrai|dois refuser|refuse de|dois décliner|pas autoris\w+|pas en mesure|impossible de vous)\b"
    r"|\b(?:no puedo|no podré|no estoy autorizad\w+|tengo que rechazar|debo rechazar|rechazar esta|debo negarme|no me es posible|no me está permitido|no tengo permitido|no debo)\b)"
)
SERVICE = (
    r"\b(?:help|assist|answer(?:ing)?|provide|comply|support|discuss|fulfil\w*|continue|respond\w*|decline|do that|allowed to do|share that|comfortable|permitted"
    r"|helfen|beantworten|behilflich|unterstützen|ablehnen|antworten|weiterhelfen|nachkommen|auskunft"
    r"|aider|répondre|refuser|fournir|assister|décliner|satisfaire|donner suite"
    r"|ayudar\w*|responder|rechazar|proporcionar|contestar|asistir|atender|negarme)\b"
)
POLICY = r"\b(?:guidelines?|polic(?:y|ies)|rules|richtlinien|vorgaben|consignes|règles|directives|normas|políticas|directrices|as an ai|as an assistant|language model|als assistent|als ki|en tant qu'?assistant|como asistente|teacher or a colleague|fachperson|enseignant|anything else you|profesor|colega)\b"
FIRST_PERSON = r"\b(?:i|i'm|i’m|me|my|ich|mir|meine?|je|j'ai|j'|me|mes|mon|yo|mis|puedo|puedo|estoy|tengo|debo|lo siento|podré|siento)\b"
REFUSALS = {
    "en": (["", "I'm sorry, but ", "Sorry — ", "Apologies, ", "Unfortunately ", "As an assistant ", "I must be honest: ", "Thanks for asking. However, "],
           ["I can't help with that", "I cannot assist with this question", "I am not able to answer this request", "I won't be able to provide this", "that is outside what I'm allowed to do", "this is something I have to decline", "I don't feel comfortable answering this"],
           ["", " in any form", " at the moment", ", because it goes against my guidelines", ". Please ask a teacher or a colleague instead"]),
    "de": (["", "Es tut mir leid, aber ", "Leider gilt: ", "Entschuldigung, "],
           ["dabei kann ich nicht helfen", "diese Anfrage darf ich nicht beantworten", "das muss ich ablehnen", "ich kann diese Frage nicht beantworten"],
           ["", ", weil es gegen meine Richtlinien verstößt", ". Bitte fragen Sie eine Fachperson"]),
    "fr": (["", "Je suis désolé, mais ", "Malheureusement, ", "Pardon, "],
           ["je ne peux pas vous aider sur ce point", "je dois refuser cette demande", "je ne suis pas autorisé à répondre"],
           ["", ", car cela va contre mes consignes", ". Adressez-vous à un enseignant"]),
    "es": (["", "Lo siento, pero ", "Por desgracia, ", "Perdona, "],
           ["no puedo ayudarte con eso", "tengo que rechazar esta petición", "no estoy autorizado a responder"],
           ["", ", porque va contra mis normas", ". Pregunta a un profesor"]),
}
ASK = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
FRAMING = frozenset("you asked question prompt the your user asks said wrote request du hast gefragt sie haben frage ihre deine vous avez demandé tu as votre la preguntas preguntaste has preguntado usted pregunta su echo query quote here is repeat answer antwort réponse respuesta q a".split())

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\w+")
_INVISIBLE = re.compile("[​‌‍⁠﻿­᠎]")
_FENCE = re.compile(r"```|~~~")
_ITEM = re.compile(r"\s*(?:\d+[.)]|[-*•+])\s+\S")
_SENTENCE_END = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]*_]*(?:\s+|(?<=[。！？]))(?=\S)")
_OTHER_SCRIPT = re.compile(r"[\u0370-\u1fff\u3040-\ud7ff]")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_KANA = re.compile(r"[぀-ヿ]")
_SCRIPTS = (("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("he", re.compile(r"[֐-׿]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("hi", re.compile(r"[ऀ-ॿ]")))
_RE = {k: re.compile(v, re.I) for k, v in {"apology": APOLOGY, "inability": INABILITY, "service": SERVICE, "policy": POLICY, "first": FIRST_PERSON}.items()}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


class Language:
    """Which language a text is in, by the lexicon and the function words."""

    def __init__(self, lexicon: list[tuple[str, str]]):
        self.of: dict[str, set[str]] = {}
        for word, lang in lexicon:
            if lang in FUNCTION_WORDS:
                self.of.setdefault(word.lower(), set()).add(lang)
        for lang, ws in FUNCTION_WORDS.items():
            for w in ws:
                self.of.setdefault(w, set()).add(lang)
        self.function = {w for ws in FUNCTION_WORDS.values() for w in ws}
        self.prefixes = {w[:k] for w in self.of for k in range(2, len(w))}

    def scores(self, words: list[str]) -> dict[str, float]:
        score: dict[str, float] = {}
        for w in words:
            for lang in self.of.get(w, ()):
                score[lang] = score.get(lang, 0.0) + 1 / len(self.of[w])
        return score

    @staticmethod
    def decide(score: dict[str, float]) -> tuple[str, float]:
        """(language, weight of the evidence); the language is "" where nothing tells."""
        if not score:
            return "", 0.0
        a = max(score, key=score.get)
        x, y = score[a], max((v for k, v in score.items() if k != a), default=0.0)
        return (a, x - y) if x - y >= 0.5 and x > 1.15 * y else ("", 0.0)

    def by_script(self, text: str) -> tuple[str, float] | None:
        """The language of a text that isn't in Latin script."""
        if not _OTHER_SCRIPT.search(text):
            return None
        signs = len(re.sub(r"\W", "", text))
        n = len(_CJK.findall(text))
        if n * 2 > signs:
            return ("ja" if _KANA.search(text) else "zh"), float(n)
        for lang, script in _SCRIPTS:
            n = len(script.findall(text))
            if n * 2 > signs:
                return lang, float(n)
        return None

    def guess(self, text: str) -> tuple[str, float]:
        return self.by_script(text) or self.decide(self.scores(words_of(text)))


_ASKED = {lang: re.compile(rf"(?:\b(?:in|into|to|auf|ins|en|al|a|au|vers|nach|中|用)\b[\s(\"“']*(?:the\s+)?(?:{names}))|\b(?:{names})\s+(?:please|bitte|only|answer|translation|version)", re.I) for lang, names in LANGUAGE_NAMES.items()}
_ANY_NAME = re.compile("|".join(LANGUAGE_NAMES.values()), re.I)


def asked_languages(prompt: str) -> set[str]:
    """Languages that a prompt asks the answer to be in."""
    return {lang for lang, form in _ASKED.items() if form.search(prompt)} if _ANY_NAME.search(prompt) else set()


def clauses_of(answer: str) -> list[tuple[str, str]]:
    """(kind, text): kind is prose, item, code, opencode or table."""
    out: list[tuple[str, str]] = []
    code: list[str] | None = None
    for line in answer.split("\n"):
        if _FENCE.match(line.strip()):
            if code is None:
                code = [line]
                if line.strip().count("```") >= 2:
                    out.append(("code", line))
                    code = None
            else:
                out.append(("code", "\n".join((*code, line))))
                code = None
        elif code is not None:
            code.append(line)
        elif line.strip():
            kind = "item" if _ITEM.match(line) else "table" if line.strip().startswith("|") else "prose"
            out += [(kind, s.strip()) for s in _SENTENCE_END.split(line) if s and s.strip()]
    if code is not None:
        out.append(("opencode", "\n".join(code)))
    return out


def is_stand_in(text: str) -> bool:
    """Whether a clause says nothing, or only that an answer is missing."""
    bare = re.sub(r"^(?:```|~~~)\w*\s*|\s*(?:```|~~~)$", "", text.strip()).strip()
    low = re.sub(r"\s+", " ", re.sub(r"^[\W_]+|[\W_]+$", "", bare)).lower()
    return not low or low in STAND_INS


def is_empty(answer: str | None) -> bool:
    return answer is None or is_stand_in(_INVISIBLE.sub("", answer))


def _plain(text: str) -> str:
    """Without identifiers and code, for telling the language."""
    return re.sub(r"\w*_\w*|`[^`]*`", " ", text) if "_" in text or "`" in text else text


class Reader:
    """Turns a pair into the clauses' features."""

    NAMES = (
        "bias", "first", "last", "only", "item", "code", "opencode", "end_mark", "no_end", "colon_end", "function_end", "cut_word", "dots", "open_bracket", "short", "apology", "inability", "service", "policy", "first_person",
        "refusal_core", "identifier", "overlap_high", "overlap_mid", "framed", "foreign", "native", "asked", "no_language", "long", "stand_in", "dots_inside",
    )

    def __init__(self, lexicon: list[tuple[str, str]]):
        self.language = Language(lexicon)
        self.at = {n: i for i, n in enumerate(self.NAMES)}

    def read(self, prompt: str, answer: str) -> tuple[list[tuple[str, str]], np.ndarray, list[int]]:
        """(clauses, features, words of each)."""
        bare = _INVISIBLE.sub("", answer)
        cl = clauses_of(bare)
        lang, _ = self.language.guess(_plain(prompt))
        asked = asked_languages(prompt)
        pw = words_of(prompt)
        grams = set(zip(pw, pw[1:], pw[2:])) if len(pw) > 2 else set()
        pset = set(pw)
        cues = any(_RE[k].search(bare) for k in ("apology", "inability", "policy"))  # else no clause can refuse
        x = np.zeros((len(cl), len(self.NAMES)))
        sizes = []
        at = self.at
        told = [(None, {}) if kind in ("code", "opencode") else (self.language.by_script(p := _plain(text)), self.language.scores(words_of(p))) for kind, text in cl]
        total: dict[str, float] = {}
        for _, score in told:
            for k, v in score.items():
                total[k] = total.get(k, 0.0) + v
        whole, _ = self.language.by_script(_plain(bare)) or self.language.decide(total)
        for i, (kind, text) in enumerate(cl):
            w = words_of(text)
            sizes.append(len(w) if kind not in ("code", "opencode") else max(1, len(w)))
            on = ["bias"]
            if i == 0:
                on.append("first")
            if i == len(cl) - 1:
                on.append("last")
            if len(cl) == 1:
                on.append("only")
            if kind in ("item", "code", "opencode"):
                on.append(kind)
            if len(text) < 60 and is_stand_in(text):
                on.append("stand_in")
            if kind not in ("code", "opencode"):
                body = text.rstrip().rstrip("*_\"'”’»`")
                on += self._ending(kind, body, text, w)
                if len(w) <= 5:
                    on.append("short")
                if len(w) >= 12:
                    on.append("long")
                ident = "_" in text and bool(re.search(r"\w_\w", re.sub(r"^\w+:\s", "", text)))
                if cues:
                    found = {k: bool(r.search(text)) for k, r in _RE.items()}
                    on += [k for k in ("apology", "inability", "service", "policy") if found[k]] + ["first_person"] * found["first"]
                    if found["inability"] and found["service"] and (found["first"] or not ident):
                        on.append("refusal_core")
                if ident:
                    on.append("identifier")
                if w and pw:
                    rest = [v for v in w if v not in FRAMING] or w
                    share = sum(t in grams for t in zip(w, w[1:], w[2:])) / (len(w) - 2) if len(w) > 4 and grams else sum(v in pset for v in rest) / len(rest)
                    if share > 0.85 and (len(rest) > 2 or len(pw) <= 4 or set(rest) == pset):
                        on.append("overlap_high")
                    elif share > 0.5:
                        on.append("overlap_mid")
                if w and all(v in FRAMING for v in w):
                    on.append("framed")
                own, weight = told[i][0] or self.language.decide(told[i][1])
                own = own if weight >= 1.5 else whole if own in ("", whole) else own
                if not own or not lang:
                    on.append("no_language")
                elif own == lang:
                    on.append("native")
                elif own in asked:
                    on.append("asked")
                else:
                    on.append("foreign")
            for n in on:
                x[i, at[n]] = 1
        return cl, x, sizes

    def _ending(self, kind: str, body: str, text: str, w: list[str]) -> list[str]:
        on = []
        last = w[-1] if w else ""
        if m := re.search(r"\s*(?:…|\.\.\.)$", body):
            on.append("dots")
            if m.start() and (last in NEVER_LAST or body[m.start() - 1] in ",;-–—(/" or body.count("(") > body.count(")") or last not in self.language.of):
                on.append("dots_inside")  # they stand where no sentence ends
        elif re.search(r"[.!?。！？|]$", body.rstrip(")]")) or re.search(r"[.!?。！？][\"'”’»)\]*_`]*$", text.rstrip()):
            on.append("end_mark")
        elif body.endswith(":"):
            on.append("colon_end")
        else:
            on.append("no_end")
            if last in NEVER_LAST:
                on.append("function_end")
            if body[-1:] in ",;-–—(/" or body.count("(") > body.count(")"):
                on.append("open_bracket")
            elif last.isalpha() and last not in self.language.of and len(last) < 15 and last in self.language.prefixes and body[-1:].isalpha():
                on.append("cut_word")
        return on


def _training(reader: Reader, rows: list[tuple[str, str]], seed: int = 7) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences with made labels from real rows."""
    rng = random.Random(seed)
    clean: list[tuple[str, str, str]] = []
    for prompt, answer in rows:
        if not prompt or is_empty(answer):
            continue
        lang, _ = reader.language.guess(prompt)
        own, weight = reader.language.guess(answer)
        cl = clauses_of(answer)
        kind, last = cl[-1]
        marks = reader._ending(kind, last, last, words_of(last)) if kind not in ("code", "opencode") else []
        doubtful = any(_RE["inability"].search(t) and _RE["service"].search(t) for _, t in cl) or kind == "opencode" or {"dots", "function_end", "open_bracket", "cut_word"} & set(marks) or ("no_end" in marks and kind == "prose" and len(last) > 25)
        pw = words_of(prompt)
        if not doubtful and lang and (own == lang or not own) and set(words_of(answer)) - set(pw) - FRAMING and len(cl) <= 16:
            clean.append((prompt, answer, lang))
    by_lang: dict[str, list[str]] = {}
    for _, a, lang in clean:
        if reader.language.guess(a)[0] == lang:
            by_lang.setdefault(lang, []).append(a)
    xs: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    stand_ins = [*sorted(STAND_INS), "-", "...", ""]

    def add(prompt: str, answer: str, label: list[int] | int) -> None:
        cl, x, _ = reader.read(prompt, answer)
        if 0 < len(cl) <= 16:  # longer ones teach nothing else
            y = np.full(len(cl), label) if isinstance(label, int) else np.array([*label, *[0] * len(cl)][: len(cl)])
            xs.append(x)
            ys.append(y)

    for prompt, answer, lang in clean:
        add(prompt, answer, 0)
        pick = rng.random()
        if pick < 0.3:
            start = answer.rfind(clauses_of(answer)[-1][1])
            n = len(answer) - start
            if n > 30 and start >= 0:
                cut = answer[: start + rng.randint(12, n - 8)]
                parts = clauses_of(cut)
                tail_kind, tail = parts[-1]
                # a list item has no end mark: cut after a whole word it can't be told from a complete one
                if tail_kind != "item" or {"function_end", "open_bracket", "cut_word"} & set(reader._ending(tail_kind, tail, tail, words_of(tail))):
                    add(prompt, cut + rng.choice(["", "", "…", "..."]), [0] * (len(parts) - 1) + [4])
        elif pick < 0.5:
            others = [v for k, v in by_lang.items() if k != lang]
            if others:
                away = rng.choice([k for k in by_lang if k != lang])
                other = rng.choice(by_lang[away])
                short = clauses_of(other)[0][1] if rng.random() < 0.4 else other
                add(prompt, short, 3)
                if rng.random() < 0.5:  # the same, asked for
                    name = ASK.get(away, away)
                    add(rng.choice(["Answer in {}, please. {}", "(reply in {}) {}", "Translate into {}: {}"]).format(name, prompt), short, 0)
        elif pick < 0.7:
            frame = rng.choice(["{}", "  {}\n", "You asked: {}", "“{}”", "> {}", "{}\n{}", "Question: {}"])
            add(prompt, rng.choice([str, str.lower, str.upper])(frame.format(prompt, prompt)), 2)
        elif pick < 0.95:
            lead, core, tail = (rng.choice(p) for p in REFUSALS.get(lang, REFUSALS["en"]))
            text = lead + core + tail + "."
            text = text[0].upper() + text[1:]
            if rng.random() < 0.2:
                k = len(clauses_of(prompt))
                add(prompt, f"{prompt}\n\n{text}", [2] * k + [1] * len(clauses_of(text)))
            else:
                add(prompt, text, 1)
        else:
            add(prompt, f"{prompt}\n\n{answer}", [2] * len(clauses_of(prompt)))
            blank = rng.choice(stand_ins)
            add(prompt, rng.choice([str, str.upper, str.capitalize])(rng.choice(["{}", "({})", "[{}]", "{}.", "```\n{}\n```", "<{}>", "**{}**"]).format(blank)), 5)
        if rng.random() < 0.1:  # a code block that is never closed
            add(prompt, f"{answer}\n\n```\n{rng.choice(['x = load(rows)', 'for row in rows:'])}\n    print(row", [0] * len(clauses_of(answer)) + [4])
    return xs, ys


def fit(rows: list[tuple[str, str]], lexicon: list[tuple[str, str]]) -> ChainCrf:
    """Fits the field; with too few usable rows it falls back to made pairs alone."""
    reader = Reader(lexicon)
    seeds = [
        ("Why is the index slow?", "The index is slow because the cache is cold. Warm it first and then load the pages of the table again before every run."),
        ("Where is the list stored?", "The list is stored in the file next to its page. Until the cache is warm, the reader loads every page from the list without any help."),
        ("Which pages are slow?", "These are slow:\n\n- the page with the long table\n- the list is on a cold page\n- the file of the index"),
        ("How do I load a table?", "1. warm the cache first\n2. load the pages of the table\n3. the reader keeps the rest"),
        ("Is the cache warm?", "Yes."), ("How many pages are there?", "42"),
        ("Wo wird die Liste gespeichert?", "Die Liste wird in der Datei gespeichert. Sie ist kurz, und ohne eine Tabelle bleibt jede Seite auch nach der Pause unklar."),
        ("Où est la liste ?", "La liste est dans le fichier. Elle est courte, mais sans une page de plus le lecteur charge toute la table après chaque passage."),
        ("¿Dónde está la lista?", "La lista está en el archivo. Es corta, pero sin una página más la tabla carga toda la carpeta después de cada vuelta."),
    ]
    xs, ys = _training(reader, [*rows, *seeds * 12])
    return ChainCrf.fit(xs, ys, len(LABELS))


def defect_of(reader: Reader, field: ChainCrf, prompt: str | None, answer: str | None) -> tuple[str | None, list[str]]:
    """(defect or None, the clauses' tags)."""
    prompt = prompt or ""
    cl, x, size = reader.read(prompt, answer or "")
    if not cl:
        return "empty", []
    tags = [LABELS[t] for t in field.tag(x)]
    if all(t == "stand_in" for t in tags):
        return "empty", tags
    share = {t: sum(n for n, g in zip(size, tags, strict=True) if g == t) / max(1, sum(size)) for t in LABELS}
    if share["echo"] > 1 - 1e-9 and _given_back(prompt, answer) >= ECHOED:
        return "copied", tags
    if share["refusal"] and share["answer"] + share["foreign"] <= 0.34 * (share["refusal"] + share["echo"]) + 1e-9:
        return "refusal", tags
    if share["foreign"] > 0.5 * (1 - share["echo"]) or (share["foreign"] and tags[-1] in ("foreign", "unfinished") and share["answer"] < share["foreign"]):
        return "other_language", tags
    if tags[-1] == "unfinished":
        return "truncated", tags
    return None, tags


def _given_back(prompt: str, answer: str) -> float:
    """The share of the prompt's words, each as often as it stands there, that the answer holds: an echo of one name of the prompt may well answer it."""
    p = Counter(words_of(prompt))
    return (p & Counter(words_of(answer))).total() / p.total() if p else 0.0


@lru_cache(maxsize=2)
def _reader(lexicon: tuple[tuple[str, str], ...]) -> Reader:
    return Reader(list(lexicon))


def tag_pairs(chats: DataFrame, lexicon: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(id, defect, tags)`` of every row, defect null for usable answers."""
    words = tuple(sorted({(r.word, r.lang) for r in lexicon.select("word", "lang").filter("word IS NOT NULL").limit(MAX_WORDS + 1).collect()}))
    if len(words) > MAX_WORDS:
        raise ValueError(f"lexicon: more than {MAX_WORDS} words; raise MAX_WORDS if executors can hold them")
    pairs = chats.select("id", "prompt", "answer").filter(F.col("id").isNotNull())
    usable = pairs.filter("prompt IS NOT NULL AND answer IS NOT NULL")
    spread = F.pmod(F.xxhash64("id"), F.lit(max(1, usable.count() // sample))) == 0  # between one and two times ``sample`` rows
    rows = usable.filter(spread).select("id", "prompt", "answer").distinct().collect()
    field = fit([(r.prompt, r.answer) for r in sorted(rows, key=lambda r: (r.id, r.prompt, r.answer))], list(words))
    one = pairs.groupBy("id").agg(F.min_by(F.struct("prompt", "answer"), F.struct(F.coalesce("answer", F.lit("")), F.coalesce("prompt", F.lit("")))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(words)
        for b in batches:
            got = [defect_of(reader, field, p, a) for p, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.list_(pa.string()))], names=["id", "defect", "tags"])

    kind = chats.schema["id"].dataType.simpleString()
    one = one.select("id", "p.prompt", "p.answer").repartition(wide(chats.sparkSession))  # heavy work on small rows
    return one.mapInArrow(run, f"id {kind}, defect string, tags array<string>")


def found(chats: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(id, defect)`` of the defective rows."""
    return tag_pairs(chats, lexicon).filter("defect IS NOT NULL").select("id", "defect")
