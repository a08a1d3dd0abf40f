"""Names and templates that hold placeholders, filler, error messages or script notices.

Character n-gram models of placeholders, of filler, of error and script notices
and of natural text are fitted; in each text the window with the greatest
likelihood ratio of each residue model to the natural one is found, and the text
is excluded by the window's ratio and by how much of the text it covers.

The residue models are fitted on phrases made from the lists below (a bounded
sample, all of it in this module). The natural model is fitted on the n-grams of
all texts that the caller gives as natural, prose among them, and on a small
sample of ordinary titles about errors, scripts and templates, so that real
documents about these are not taken for them.

The natural model that is sent to the workers holds the ``MOST_GRAMS`` commonest
n-grams; the counts of rarer ones go to their last characters, so that nothing
is left out of the shorter contexts.

Defined results: null, empty and blank texts hold no residue; long texts are
read whole; ties between windows go to the first; repeated rows give repeated
rows; extra columns are kept as they are, but for ``residue``, which is replaced.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, spread
from .confusables import consistent

ORDER = 4
#: N-grams of the natural model that are sent to the workers as they are.
MOST_GRAMS = 200_000
#: N-grams that a worker remembers the ratios of; emptied when full.
KNOWN_GRAMS = 300_000
#: Weight of the natural texts against the sample of titles.
NATURAL_WEIGHT = 4.0
KINDS = ("placeholder", "empty", "stub", "filler", "notice")
#: Least log likelihood ratio of a window, by kind, where it covers at least the share below of the text's letters.
LEAST_SCORE = {"placeholder": 8.0, "empty": 5.5, "stub": 5.0, "filler": 8.0, "notice": 8.0}
LEAST_COVER = {"placeholder": 0.0, "empty": 0.8, "stub": 0.45, "filler": 0.3, "notice": 0.6}
#: Least ratio of a window, by kind, whatever it covers.
CERTAIN = {"placeholder": 8.0, "empty": 8.2, "stub": 20.0, "filler": 16.0, "notice": 14.0}
#: Least ratios of placeholders and empty values whose brackets or signs bring at least the part named first.
MARKED = {"placeholder": ((2.0, 3.7), (0.5, 5.5)), "empty": ((2.0, 3.2),)}
#: Least ratio of a window that is looked at.
LEAST_ANY = min(least for pairs in MARKED.values() for _, least in pairs)
#: Least part of a window's ratio that its letters must bring.
LEAST_SPOKEN = -0.5
#: Least likelihood of a character under the natural alternative, which holds words that no model knows, such as invented names.
UNKNOWN = {"letter": 1 / 20, " ": 1 / 12, "0": 1 / 8, "other": 1 / 200}

# Fields that unfinished templates name.
FIELDS = """titlu|title|titel|titre|titulo|nume|name|nom|nombre|nachname|vorname|prenume|prenom|autor|author|auteur|beneficiar|beneficiary|client|nume client|client name|clientname|
customer|customer name|vendor|vendor.name|vendor name|issuer|emitent|furnizor|supplier|suma|total|amount|betrag|montant|importe|date|data|datum|fecha|data emiterii|dataemiterii|issue date|
doc type|doctype|document type|tip document|tipdocument|subject|subiect|subiectai|betreff|invoice no|invoice number|nr factura|numar factura|rechnungsnummer|an fiscal|fiscal year|an|luna|month|year|
file.name|file name|filename|nume fisier|company|company name|firma|firm|address|adresa|oras|city|email|phone|telefon|description|descriere|category|categorie|number|numar|id|first name|last name|full name|employee|angajat|
insert title|insert name|insert date|completati aici|completeaza aici|de completat|your name|your company|object object|original filename|extension|placeholder|value|valoare""".replace("\n", "").split("|")
WRAPPERS = "[|]\n[[|]]\n{|}\n{{|}}\n{{ | }}\n${|}\n<|>\n<<|>>\n((|))\n%|%\n$|$\n@@|@@\n#|#\n&|&\n__|__\n___|___\n___|__\n__|___\n{%|%}\n{% | %}\n_|__\n__|_".split("\n")
MARKS = """xxxx xx xx|xxxx-xx-xx|xx.xx.xxxx|xx xx xxxx|zz.ll.aaaa|zz ll aaaa|zz.mm.aaaa|yyyymmdd|yyyy mm dd|yyyy.mm.dd|dd.mm.yyyy|dd mm yyyy|mm dd yyyy|ddmmyyyy|jjjj mm tt|tt.mm.jjjj|aaaa.ll.zz|%s|%d|{0}|{1}|#ref!|#n/a|#value!|#name?|
[object object]|insert name here|insert title here|insert text here|insert date here|your title here|your name here|your text here|
name goes here|title goes here|nume de completat|titlu de completat|de completat|completati aici|titlu fisier aici|nume fisier aici|titlul aici|numele aici|hier titel einfugen|titel hier|name hier|
titre ici|inserer le titre|nombre aqui|titulo aqui|descriptive name based on content|{original_filename}|name of file here|file name here|titlu document aici""".replace("\n", "").split("|")
STUBS = "placeholder|placeholder name|placeholder text|placeholder title|placeholder 00|untitled|untitled 00".split("|")
EMPTY = "undefined|undefined undefined|null null|null null null|null_null|nan nan|nan_nan|nan nan nan|none none|tbd|tbd tbd|todo|to do|fixme|%s|%d|{0}|{1}|n/a|tba|untitled|untitled 0|noname|no name|fara nume|fara titlu|unbenannt|sans titre|sin titulo".split("|")
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur".split()
FILLER = """asdf asdf|asdfgh asdfgh|asdf qwer|qwerty test qwerty|qwerty qwerty|test test 000 test|test test test|test test 000|test 000 test|foo bar baz|foo bar|foo bar baz qux|bla bla bla|blah blah blah|aaaa bbbb cccc|aaa bbb ccc|abc abc abc|xxx yyy zzz|xxxx xxxx|
text exemplu text exemplu|text exemplu|text de exemplu|text de umplutura|text provizoriu|text de proba|beispieltext hier|beispieltext|blindtext hier|platzhaltertext|mustertext hier|texte d'exemple ici|texte exemple|texto de ejemplo|texto de prueba|
sample text goes here|sample text|sample text here|dummy text|dummy text here|example text goes here|filler text|some text here|text goes here|your text goes here|hello world test|jkl jkl|zxcv zxcv|123 123 test""".replace("\n", "").split("|")
CODES = "400 401 403 404 405 408 410 413 422 429 500 501 502 503 504".split()
MESSAGES = """bad request|unauthorized|forbidden|not found|page not found|method not allowed|request timeout|gone|too many requests|internal server error|server error|not implemented|bad gateway|service unavailable|gateway timeout|page missing|page does not exist|
pagina lipseste|pagina nu a fost gasita|pagina inexistenta|pagina nu exista|serviciu indisponibil|prea multe cereri|acces interzis|acces refuzat|eroare interna de server|eroare de server|cerere gresita|neautorizat|timp depasit|timpul a expirat|
seite nicht gefunden|zugriff verweigert|interner serverfehler|dienst nicht verfugbar|zu viele anfragen|page introuvable|acces refuse|erreur interne du serveur|service indisponible|trop de requetes|pagina no encontrada|acceso denegado|error interno del servidor|servicio no disponible|demasiadas solicitudes""".replace("\n", "").split("|")
CALLS = "error|http error|http|status|status code|eroare|eroarea|fehler|erreur|error code|cod eroare|server error".split("|")
ERRORS = """oops page does not exist|oops, page does not exist|oops something went wrong|something went wrong|ceva nu a mers bine|an error occurred|an unexpected error occurred|a aparut o eroare|s-a produs o eroare|es ist ein fehler aufgetreten|une erreur est survenue|ha ocurrido un error|etwas ist schiefgelaufen|
access denied|permission denied|you do not have permission to view this page|connection timed out|connection refused|connection reset|connection lost|request timed out|session expired|your session has expired|sesiunea a expirat autentificati va din nou|sesiunea a expirat, autentificati va din nou|sesiunea a expirat|sitzung abgelaufen|session expiree|
this file could not be opened|this page could not be loaded|this page can't be displayed|file not found|file could not be read|fisierul nu a putut fi deschis|documentul nu a putut fi incarcat|die datei konnte nicht geoffnet werden|le fichier n'a pas pu etre ouvert|
traceback (most recent call last)|traceback most recent call last|unhandled exception|null pointer exception|stack overflow exception|segmentation fault|index out of range|keyerror|valueerror|
request failed with status code 000|request failed with status 000|failed to load resource|failed to fetch|eroare raspuns gol de la model|eroare procesare text|eroare extractie|eroare vision ai|raspuns gol de la server|empty response from model|invalid json response|could not parse response|rate limit exceeded|quota exceeded|
temporarily unavailable|site under maintenance|site in constructie|please try again later|incercati din nou mai tarziu|bitte versuchen sie es spater erneut|veuillez reessayer plus tard|captcha required|are you a robot|verify you are human""".replace("\n", "").split("|")
SCRIPTS = "javascript|js|scripts|java script|cookies and scripts|cookies|scripting"
ASK = "please enable|enable|turn on|allow|you must allow|you must enable|you need to turn on|you need to enable|please turn on|please allow|activate"
THEN = "|to continue|to view this file|to view this page|in your browser|in this browser|and reload|and reload the page|to use this site|and try again|for this site"
ASK_RO = "activati|porniti|permiteti|va rugam sa activati|trebuie sa activati|activati va rugam"
SCRIPTS_RO = "javascript|js|scripturile|scripturi|java script|javascript-ul"
THEN_RO = "|pentru a continua|pentru a vedea pagina|pentru a vedea fisierul|in browser|si reincarcati pagina|in acest browser|pentru acest site"
NOTICES = """javascript is required|javascript is disabled|javascript is not enabled|javascript must be enabled|scripts are disabled|scripts are required|your browser does not run scripts|your browser does not support javascript|this site requires javascript|this page needs javascript|noscript scripturile sunt dezactivate|noscript|
scripturile trebuie pornite pentru acest site|scripturile sunt dezactivate|javascript este dezactivat|este nevoie de javascript|browserul nu ruleaza scripturi|acest site necesita javascript|
bitte javascript aktivieren|bitte aktivieren sie javascript|javascript ist deaktiviert|javascript wird benotigt|veuillez activer javascript|javascript est desactive|activez javascript|javascript est requis|por favor active javascript|active javascript para continuar|javascript esta desactivado|se requiere javascript""".replace("\n", "").split("|")
# Ordinary words that residue has too, the kinds of documents that they stand in, and what may go with them.
TITLE_KINDS = "raport|ghid|manual|tabel|analiza|atelier|exercitii|poster|afis|studiu|curs|nota|plan|proces verbal|lista|formular|sablon|test|fisa|proiect|tema|articol|prezentare|report on|guide to|handbook|workshop|notes on|introduction to|leitfaden|bericht uber|rapport sur|guia de|study|analysis of|checklist|tutorial".split("|")
ORDINARY = """javascript|java script|js|script|scripts|scripturi|server|errors|erori|timeouts|timeout|null|nan|none|undefined|placeholder|template|templates|sablon|test|teste|acces|page|pages|pagina|pagini|
cookies|browser|exemplu|sample|text|texte|filler|missing|lipsa|format|date format|data|draft|title|name|nume|titlu|insert""".replace("\n", "").split("|")
COMPLEMENTS = "avansati|copii|extern|central|lunar|anual|arhiva|retea|birou|nou|noua|vechi|cladire|laborator|fizica|istorie|muzica|teatru|film|auto|medical|statistica|geografie|in practica|si solutii|pentru studenti|de referinta|for beginners|in practice|and solutions|basics|design|history|rooms|fur anfanger|grundlagen|pour debutants|para principiantes".split("|")
PLAIN = """factura|chitanta|contract|aviz|oferta|notificare|diploma|adeverinta|notite|curs|cap|nr|copie|copy|scan|document|dosar|arhiva|model|invoice|receipt|report|letter|photo|summary|meeting|budget|holiday|family|house|garden|uber strassenbau|rechnung|brief|foto|rapport|lettre|carta|informe""".split("|")

# Ordinary remarks in brackets.
BRACKETED = "semnat|duplicat|model b|model a|model c|final|copie|copy|1|2|3|00|scan|original|draft|vechi|nou|urgent|confidential|signed|revizuit|anexa 1|partea 2|ro|en|de|color|alb negru|varianta 2|v2".split("|")

# The tokens of naming templates, which are left over where they stand in a name.
OWN_TOKENS = ["[An]", "[Luna]", "[TipDocument]", "[Emitent]", "[SubiectAI]", "{original_filename}"]
#: Tokens that are legitimate in naming templates.
TEMPLATE_TOKENS = r"\[(?:An|Luna|TipDocument|Emitent|SubiectAI)\]|\{original_filename\}|descriptive_name_based_on_content"


def read(text: str) -> str:
    """Lower case without accents; digits as 0; single separators as blanks, unusual underlines kept; other alphabets as one letter."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", consistent(text) or "") if not unicodedata.combining(c)).lower()
    plain = re.sub(r"\.(?:pdf|docx?|xlsx?|txt|csv|md|jpe?g|png|bmp|tiff?|gif|webp|odt|rtf)$", "", plain.strip())
    plain = re.sub(r"(?<=[^\W_])_(?=[^\W_])", " ", re.sub(r"_[-–]_|(?<=[^\W_])_(?=[\s(])|(?<=\))_", " ", plain))
    plain = re.sub(r"[\s\-–]+", " ", re.sub(r"\d+", lambda m: "0" * min(len(m[0]), 6), plain))
    return " " + "".join(c if ord(c) < 128 else "\x7f" for c in plain).strip(" ") + " "


def grams(text: str) -> Iterator[str]:
    padded = "\x02" * (ORDER - 1) + text
    return (padded[i : i + ORDER] for i in range(len(text)))


class Model:
    """Witten-Bell interpolated n-grams over at most 128 characters."""

    def __init__(self, counts: Iterable[tuple[str, float]]):
        self.next: list[dict[str, dict[str, float]]] = [defaultdict(lambda: defaultdict(float)) for _ in range(ORDER)]
        for gram, n in counts:
            for k in range(len(gram)):  # shorter ones tell of short contexts only
                self.next[k][gram[len(gram) - 1 - k : -1]][gram[-1]] += n
        self.sums = [{c: (sum(d.values()), len(d)) for c, d in level.items()} for level in self.next]
        self.known: dict[str, float] = {}

    def log(self, gram: str) -> float:
        got = self.known.get(gram)
        if got is None:
            p = 1 / 128
            for k in range(ORDER):
                context = gram[ORDER - 1 - k : ORDER - 1]
                if context in self.sums[k]:
                    total, kinds = self.sums[k][context]
                    p = (self.next[k][context].get(gram[-1], 0.0) + kinds * p) / (total + kinds)
            got = self.known[gram] = math.log(p)
        return got


def _count(phrases: Iterable[str], weight: float = 1.0) -> Counter:
    out: Counter = Counter()
    for phrase in phrases:
        for g in grams(read(phrase)):
            out[g] += weight
    return out


def residue_phrases() -> dict[str, list[str]]:
    """The phrases that the residue models are fitted on."""
    wrapped = [(w.split("|")[0] + f + w.split("|")[1]) for w in WRAPPERS for f in FIELDS]
    wrapped += [w.replace(" ", "_") for w in wrapped if " " in w]
    lorem = [" ".join(LOREM[i : i + n]) for i in range(len(LOREM)) for n in (2, 3, 4, 5, 6)]
    errors = [f"{c} {k} {m}" for c, k, m in itertools.product(CALLS, ("000",), MESSAGES)] + [f"{c} 000: {m}" for c, m in itertools.product(CALLS, MESSAGES)]
    errors += [f"{c} 000 - {m}" for c, m in itertools.product(CALLS, MESSAGES)] + [f"000 {m}" for m in MESSAGES] * 4 + [f"{m} (000)" for m in MESSAGES] * 4 + MESSAGES * 12 + ERRORS * 6
    asks = [f"{a} {s} {t}" for a, s, t in itertools.product(ASK.split("|"), SCRIPTS.split("|"), THEN.split("|"))]
    asks += [f"{a} {s} {t}" for a, s, t in itertools.product(ASK_RO.split("|"), SCRIPTS_RO.split("|"), THEN_RO.split("|"))]
    return {"placeholder": wrapped + MARKS * 12 + OWN_TOKENS * 40, "empty": EMPTY, "stub": STUBS, "filler": lorem + FILLER * 8, "notice": errors + asks + NOTICES * 8}


def natural_phrases() -> list[str]:
    titles = [f"{k} {t}{y}" for k, t, y in itertools.product(TITLE_KINDS, ORDINARY, ("", " 0000"))] + [f"{t} {k}{y}" for k, t, y in itertools.product(TITLE_KINDS, ORDINARY, ("", " 0000"))]
    titles += [f"{t} {c}{y}" for t, c, y in itertools.product(ORDINARY, COMPLEMENTS, ("", " 0000"))] + [f"{k} {t} {c}" for k, t, c in itertools.product(TITLE_KINDS[:12], ORDINARY, COMPLEMENTS)]
    bracketed = [f"{p} {a}{t}{b} 2000" for p in PLAIN[:12] for t in BRACKETED * 8 for a, b in ("[]", "{}", "()")]
    other = ["\u4e00" * n + " 00000" for n in range(1, 9)] * 40 + [f"{chr(0x4E00) * n} {chr(0x4E00) * m} 00000" for n in range(1, 10) for m in range(1, 10)] * 10
    return bracketed + other + titles + PLAIN * 20 + [f"{a} {b} 2000 00000" for a, b in itertools.product(PLAIN, PLAIN)]


def _folded() -> dict[int, str]:
    """Letters of the Latin blocks by their plain form, other alphabets as one letter; made by rule."""
    out = {}
    for code in range(0x80, 0x3000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        out[code] = plain if plain.isascii() and (plain or unicodedata.combining(chr(code))) else "\x7f"
    return out | {ord("_"): " ", ord("/"): " ", ord("\\"): " ", ord("-"): " "}


def fold_prose(text: str, table: dict[int, str]) -> str:
    """``read`` for long natural texts, near enough and fast."""
    plain = re.sub(r"\s+", " ", re.sub(r"\d", "0", text.lower().translate(table)))
    return " " + re.sub(r"[^\x20-\x7e]", "\x7f", plain).strip() + " "


def natural_grams(texts: DataFrame) -> list[tuple[str, int]]:
    """Counts of all n-grams of the column ``text``; of those beyond the ``MOST_GRAMS`` commonest, the counts of their last characters."""
    powers = 128 ** np.arange(ORDER - 1, -1, -1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, held = _folded(), pd.Series(dtype="int64")
        for batch in batches:
            padded = "".join("\x02" * (ORDER - 1) + fold_prose(t, table) for t in batch["text"] if t and t.strip())
            codes = np.frombuffer(padded.encode("latin-1"), dtype=np.uint8).astype(np.int64)
            if len(codes) < ORDER:
                continue
            grams_here = np.lib.stride_tricks.sliding_window_view(codes, ORDER) @ powers
            keys, n = np.unique(grams_here[codes[ORDER - 1 :] != 2], return_counts=True)
            held = held.add(pd.Series(n, index=keys), fill_value=0)
            if len(held) > 1_000_000:
                yield pd.DataFrame({"gram": held.index.astype("int64"), "n": held.to_numpy().astype("int64")})
                held = pd.Series(dtype="int64")
        yield pd.DataFrame({"gram": held.index.astype("int64"), "n": held.to_numpy().astype("int64")})

    counts = materialise(texts.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")

    def letters(code: int, size: int) -> str:
        return "".join(chr(code >> 7 * k & 127) for k in range(size - 1, -1, -1))

    common = counts.orderBy(F.desc("n"), "gram").limit(MOST_GRAMS).collect()
    out = [(letters(r["gram"], ORDER), r["n"]) for r in common]
    if len(common) == MOST_GRAMS:
        last = common[-1]
        rest = counts.where((F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("gram") > last["gram"]))
        shorter = rest.groupBy((F.col("gram") % 128**2).alias("gram")).agg(F.sum("n").alias("n")).collect()  # at most 128 * 128
        out += [(letters(r["gram"], 2), r["n"]) for r in shorter]
    return out


class Finder:
    def __init__(self, natural: list[tuple[str, int]]):
        total = sum(n for _, n in natural) or 1
        counts = _count(natural_phrases())
        own = sum(counts.values())
        for g, n in natural:
            counts[g] += NATURAL_WEIGHT * n * own / total
        self.natural = Model(counts.items())
        self.models = {k: Model(_count(p).items()) for k, p in residue_phrases().items()}
        self.known: dict[str, list[float]] = {}

    def ratios(self, gram: str) -> list[float]:
        """The log likelihood ratios of a character by kind, then again what counts as letters, then as signs."""
        found = self.known.get(gram)
        if found is None:
            last = gram[-1]
            if "\x7f" in gram:  # letters of other alphabets tell nothing
                own = [0.0] * len(KINDS)
            else:
                base = max(self.natural.log(gram), math.log(UNKNOWN["letter" if last.isalpha() else last if last in UNKNOWN else "other"]))
                own = [self.models[k].log(gram) - base for k in KINDS]
            zero = [0.0] * len(KINDS)
            found = own + (own if last.isalpha() else zero) + (zero if last.isalnum() or last == " " else own)
            if len(self.known) >= KNOWN_GRAMS:
                self.known.clear()
            self.known[gram] = found
        return found

    def windows(self, text: str) -> dict[str, list[tuple[float, int, int, float, float]]]:
        """By kind: the maximal windows, each with its summed log likelihood ratio, its ends, and the parts of the sum due to letters and to
        signs: the greatest first, then the greatest beside it, as long as they may tell anything."""
        padded = "\x02" * (ORDER - 1) + text
        sums = np.zeros((len(text) + 1, 3 * len(KINDS)))
        np.cumsum([self.ratios(padded[i : i + ORDER]) for i in range(len(text))], axis=0, out=sums[1:])
        out = {}
        for i, kind in enumerate(KINDS):
            own, found, waiting = sums[:, i], [], [(0, len(text))]
            while waiting:
                low, high = waiting.pop(0)
                rise = own[low : high + 1] - np.minimum.accumulate(own[low : high + 1])
                end = low + int(np.argmax(rise))
                if rise[end - low] < LEAST_ANY:
                    continue
                start = low + int(np.argmin(own[low : end + 1]))
                score, spoken, marks = (float(sums[end, i + k * len(KINDS)] - sums[start, i + k * len(KINDS)]) for k in range(3))
                found.append((score, start, end, spoken, marks))
                waiting += [(low, start), (end, high)]
            out[kind] = found
        return out

    def judge(self, text: str | None, template: bool = False) -> tuple[str | None, float, float]:
        """(kind or None, ratio, coverage)"""
        if text is None or not text.strip():
            return None, 0.0, 0.0
        if template:
            text = re.sub(r"(?: - |[_\- ])?(?:%s)(?: - |[_\- ])?" % TEMPLATE_TOKENS, " ", text)
        plain = read(text)
        letters = sum(c.isalnum() or c == "\x7f" for c in re.sub(r"(?<![^ ])0+(?![^ ])", "", plain)) or 1
        answer = (None, 0.0, 0.0)
        for kind, (score, a, b, spoken, marks) in ((kind, window) for kind, found in self.windows(plain).items() for window in found):
            if spoken < LEAST_SPOKEN:  # brackets alone are no residue; what stands in them must be
                continue
            cover = sum(c.isalnum() for c in plain[a:b]) / letters
            marked = any(marks >= part and score >= least for part, least in MARKED.get(kind, ()))
            if (marked or score >= CERTAIN[kind] or score >= LEAST_SCORE[kind] and cover >= LEAST_COVER[kind]) and score > answer[1]:
                answer = (kind, score, min(cover, 1.0))
        return answer


RESULT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cover", T.DoubleType())])


_BUILT: dict[int, Finder] = {}


def find_residue(texts: DataFrame, natural: DataFrame, column: str, template: str | None = None) -> DataFrame:
    """Adds residue (kind, score, cover); kind is null where the text holds none. ``template`` names a boolean column:
    whether the text is a template. ``natural`` has the column ``text``. Each distinct text is judged once."""
    texts = texts.drop("residue")
    as_template = F.coalesce(F.col(template), F.lit(False)) if template else F.lit(False)
    sent = texts.sparkSession.sparkContext.broadcast(natural_grams(natural))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = None
        for batch in batches:
            if finder is None:
                key = hash(tuple(sent.value))
                if key not in _BUILT:
                    _BUILT.clear()
                    _BUILT[key] = Finder(sent.value)
                finder = _BUILT[key]
            found = [finder.judge(v, bool(t)) for v, t in zip(batch["text"], batch["template"])]
            yield batch.assign(**{name: [f[i] for f in found] for i, name in enumerate(RESULT.names)})

    # The row travels as one column, so whatever its columns are called does no harm.
    packed = texts.select(F.col(column).alias("text"), as_template.alias("template"), F.struct("*").alias("row"))
    distinct = spread(packed.select("text", "template").where("text is not null").distinct(), "text")
    judged = materialise(distinct.mapInPandas(judge, T.StructType([T.StructField("text", T.StringType()), T.StructField("template", T.BooleanType()), *RESULT.fields])), "judged")
    judged = judged.select("text", "template", F.struct(*RESULT.names).alias("residue"))
    nothing = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cover"))
    return packed.join(judged, ["text", "template"], "left").select("row.*", F.coalesce("residue", nothing).alias("residue"))
