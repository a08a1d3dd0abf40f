"""Freely typed values mapped to the entries of a reference list.

A symmetric-delete dictionary of the list's words and whole phrases finds, for
each word of a value, every list word within a bounded number of edits; entries
are ranked by weighted Damerau-Levenshtein distance over their words, then by
how often each entry is used exactly. Words that qualify a value, shortened
words, words run together and other languages' terms are understood.

The dictionary is broadcast in parts of at most ``PART_TERMS`` terms; a larger
list is looked up part by part, and the best entry of all parts is taken.
Each distinct value is looked up once.

Defined results: null, blank and ignorable values (parameter) are not looked
up and have no entry; values beyond reach have entry -1; very long values are
looked up whole, word by word; ties go to the entry used more often, then to
the smaller key; an empty list maps everything to -1; extra columns of the
input are kept as they are.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, spread
from .confusables import consistent

#: Terms of the list in one broadcast part of the dictionary.
PART_TERMS = 5_000
#: Longest word, and most edits, that deletes are made for; more would be too many.
LONG, MOST_DELETES = 40, 2
#: Weighted distance per letter of the entry up to which a match counts.
REACH = 0.34

# Words of the list's languages that do not tell entries apart.
SMALL = frozenset("de la al a ale cu pe din si of the and for in un une a an der die das von du des el los".split())
# Words that qualify a value without changing what it is.
QUALIFIERS = frozenset(
    """copie copia copy original originala scan scanat scanata scanare semnat semnata nesemnat vechi veche nou noua urgent urgenta client clientului furnizor
    document documentul documente doc fisier tip tipul fel felul un o nr numar numarul pdf jpg jpeg png docx final finala finalizat draft ciorna
    emisa emis primita primit platita platit neplatita anulat anulata duplicat actualizat actualizata partial integral aprobat simplu simpla complet completa
    old new signed unsigned scanned draft duplicate paid unpaid kind type some file versiune versiunea v1 v2 an anul luna pagina""".split()
)
# Terms of other languages, by a term of the list that means the same.
FOREIGN = {
    "invoice": "rechnung facture factura fattura", "receipt": "quittung kassenbon reçu recu recibo", "lease agreement": "mietvertrag bail;contrat de location;contrat de bail;contrato de alquiler;rental agreement;rental contract",
    "employment contract": "arbeitsvertrag;contrat de travail;contrato de trabajo;work contract;labour contract", "contract addendum": "vertragszusatz nachtrag avenant anexo;zusatzvereinbarung;amendment",
    "bank statement": "kontoauszug;relevé bancaire;relevé de compte;extracto bancario;extracto de cuenta;account statement", "payment order": "zahlungsauftrag überweisung;ordre de paiement;ordre de virement;orden de pago",
    "delivery note": "lieferschein albarán;bon de livraison;nota de entrega", "birth certificate": "geburtsurkunde;acte de naissance;certificat de naissance;certificado de nacimiento;partida de nacimiento",
    "marriage certificate": "heiratsurkunde eheurkunde;acte de mariage;certificat de mariage;certificado de matrimonio", "bachelors diploma": "bachelorzeugnis;diplôme de licence;título de grado;hochschuldiplom;bachelor degree",
    "transcript of records": "notenspiegel;relevé de notes;expediente académico", "resume": "lebenslauf;hoja de vida;currículum", "cover letter": "anschreiben motivationsschreiben;lettre de motivation;carta de presentación;carta de motivación",
    "lecture notes": "vorlesungsnotizen mitschrift vorlesungsskript;notes de cours;apuntes de clase;course notes", "homework": "hausaufgabe hausaufgaben devoirs deberes;devoir maison;tarea", "exam paper": "prüfungsaufgabe klausur examen;sujet d'examen",
    "job description": "stellenbeschreibung;fiche de poste;descripción del puesto", "payslip": "gehaltsabrechnung lohnzettel nómina;bulletin de paie;fiche de paie;bulletin de salaire;salary slip;pay slip", "tax return": "steuererklärung;déclaration fiscale;déclaration d'impôts;declaración fiscal;declaración de impuestos;declaración de la renta",
    "minutes of meeting": "protokoll;procès-verbal;acta de reunión;acta;sitzungsprotokoll;meeting minutes", "medical prescription": "rezept ordonnance receta;ordonnance médicale;receta médica;prescription", "lab results": "laborbefund laborwerte;analyses de laboratoire;résultats de laboratoire;análisis de laboratorio;laborergebnisse;blood test",
    "referral note": "überweisungsschein;lettre d'orientation;volante de derivación;referral", "insurance policy": "versicherungspolice versicherungsschein;police d'assurance;póliza de seguro;assurance", "identity card": "personalausweis;carte d'identité;documento de identidad;tarjeta de identidad;id card;carnet de identidad",
    "passport": "reisepass passeport pasaporte", "driving licence": "führerschein;permis de conduire;carnet de conducir;permiso de conducir;driver license;driving license", "vehicle registration": "fahrzeugschein zulassungsbescheinigung;carte grise;permiso de circulación;kfz-schein", "plane ticket": "flugticket;billet d'avion;billete de avión;flight ticket",
    "hotel booking": "hotelbuchung hotelreservierung;réservation d'hôtel;réservation hôtel;reserva de hotel;hotel reservation", "warranty card": "garantiekarte garantieschein;carte de garantie;certificat de garantie;tarjeta de garantía;garantía;warranty", "user manual": "bedienungsanleitung benutzerhandbuch gebrauchsanweisung;manuel d'utilisation;mode d'emploi;manual de usuario;manual de instrucciones;instructions",
    "quotation": "angebot devis presupuesto;cotización;oferta comercial;offre commerciale;offer;quote", "purchase order": "bestellung;bon de commande;orden de compra;pedido", "payment reminder": "zahlungserinnerung mahnung;rappel de paiement;recordatorio de pago;avis de paiement",
    "leave request": "urlaubsantrag;demande de congé;solicitud de vacaciones;vacation request", "proof of employment": "arbeitsbescheinigung;attestation de travail;attestation d'emploi;certificado de empleo;certificado de trabajo;employment certificate", "floor plan": "grundriss bauplan;plan d'architecte;plan architectural;plano arquitectónico;plano;architectural plan",
    "photo": "foto fotografía photographie;photograph;picture", "screenshot": "bildschirmfoto;capture d'écran;captura de pantalla;screen capture", "slides": "präsentation présentation presentación folien;diapositives;presentation", "spreadsheet": "tabelle tabellenkalkulation tableur;feuille de calcul;hoja de cálculo", "annual report": "jahresbericht geschäftsbericht;rapport annuel;informe anual;memoria anual",
}

# Endings of plural, article and case in the list's language, longest first.
ENDINGS = ("urilor", "ului", "urile", "elor", "ilor", "uri", "ele", "ile", "lor", "ul", "le", "ii", "a", "e", "i", "u")
_ENDS = tuple(sorted(QUALIFIERS | {w for w in SMALL if len(w) > 1}))
_MARKS = re.compile(r"[^\W_]+\.?")
_CAMEL = re.compile(r"(?<=[^\W\d_A-ZĂÂÎȘȚ])(?=[A-ZĂÂÎȘȚ])")
_KEYS = {c: (x, y) for y, row in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm")) for x, c in enumerate(row)}


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", consistent(text) or "")
    return "".join(c for c in plain if not unicodedata.combining(c)).lower().replace("ß", "ss").replace("œ", "oe")


def deletes(word: str, most: int) -> set[str]:
    """The word without up to ``most`` of its letters."""
    found, last = {word}, {word}
    for _ in range(min(most, max(len(word) - 1, 0))):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found |= last
    return found


def weighted_distance(a: str, b: str, most: float = 99.0) -> float:
    """Damerau-Levenshtein distance; swapped neighbours and doubled letters cost 0.7, neighbouring keys 0.8, others 1."""
    if abs(len(a) - len(b)) > most / 0.7 + 1:
        return 99.0
    before: list[float] = []
    last = [0.0]
    for j in range(len(b)):
        last.append(last[-1] + (0.7 if j and b[j] == b[j - 1] else 1.0))
    for i, x in enumerate(a):
        row = [last[0] + (0.7 if i and a[i - 1] == x else 1.0)]
        for j, y in enumerate(b):
            if x == y:
                cost = last[j]
            else:
                near = x in _KEYS and y in _KEYS and abs(_KEYS[x][0] - _KEYS[y][0]) <= 1 and abs(_KEYS[x][1] - _KEYS[y][1]) <= 1
                cost = last[j] + (0.8 if near else 1.0)
            cost = min(cost, last[j + 1] + (0.7 if i and a[i - 1] == x else 1.0), row[j] + (0.7 if j and b[j - 1] == y else 1.0))
            if i and j and x == b[j - 1] and y == a[i - 1]:
                cost = min(cost, before[j - 1] + 0.7)
            row.append(cost)
        if min(row) > most:
            return 99.0
        before, last = last, row
    return last[-1]


def edits(a: str, b: str, most: int) -> int:
    """Letters added, lost or changed and neighbours swapped; ``most`` + 1 if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            cost = min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1)
            if i and j and x == b[j - 1] and y == a[i - 1]:
                cost = min(cost, before[j - 1] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def edits_for(word: str) -> int:
    """Slips allowed in a word of this length."""
    return 0 if len(word) < 3 else 1 if len(word) < 5 else 2


def edits_for_phrase(phrase: str) -> int:
    """Slips allowed in a whole phrase that is written as one word."""
    return 0 if len(phrase) < 5 else 1 if len(phrase) < 8 else 2 if len(phrase) < 12 else 3


class Deletes:
    """A symmetric-delete index: all its words within the edits that their lengths allow, exactly.

    Deletes serve up to ``MOST_DELETES`` edits of words up to ``LONG`` letters. Beyond that the words are told apart by how often
    each letter comes: an edit changes two of these counts at most.
    """

    def __init__(self, allowed: Callable[[str], int], words: Iterable[str]):
        self.allowed = allowed
        self.by_delete: dict[str, set[str]] = defaultdict(set)
        wide = []
        for w in sorted(words):
            if len(w) <= LONG:
                for d in deletes(w, min(allowed(w), MOST_DELETES)):
                    self.by_delete[d].add(w)
            if len(w) > LONG or allowed(w) > MOST_DELETES:
                wide.append(w)
        self.wide = np.array(wide, dtype=object)
        self.counts = np.array([_letters(w) for w in wide], dtype=np.int32).reshape(len(wide), 32)
        self.longest = max(map(len, wide), default=LONG)

    def near(self, word: str) -> dict[str, float]:
        """The index's words within reach of ``word``, with their weighted distance. The edits allowed are those of the shorter word."""
        most = self.allowed(word)
        met: set[str] = set()
        if len(word) <= LONG + most:
            for d in deletes(word, min(most, MOST_DELETES)):
                met |= self.by_delete.get(d, set())
        if len(self.wide) and (len(word) + most > LONG or most > MOST_DELETES) and len(word) <= self.longest + most:
            met.update(self.wide[np.abs(self.counts - _letters(word)).sum(axis=1) <= 2 * most])
        out = {}
        for w in met:
            if w == word:
                out[w] = 0.0
            elif edits(word, w, least := min(most, self.allowed(w))) <= least:
                out[w] = weighted_distance(word, w)
        return out


def _letters(word: str) -> np.ndarray:
    return np.bincount(np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32) % 32, minlength=32)


def _is_short(short: str, word: str) -> bool:
    """Whether ``short`` may stand for ``word``: its beginning, or its consonants in order from the first letter on."""
    if len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    rest = iter(word)
    return len(short) >= 3 and not any(c in "aeiou" for c in short[1:]) and all(c in rest for c in short)


def stem(word: str) -> str:
    """The word without one ending, where at least three letters stay."""
    for end in ENDINGS:
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


#: The best rank (leftover words, distance, less frequency, key) or None, and ranks of entries met by a lone shortened word, each with whether that word is long enough.
Best = tuple[tuple | None, list[tuple[tuple, bool]]]


class Dictionary:
    """entries: (key, term, frequency); the terms of one key are its label, aliases and translations."""

    def __init__(self, entries: list[tuple[int, str, int]]):
        self.terms: list[tuple[int, tuple[str, ...], int]] = []
        self.holding: dict[str, set[int]] = defaultdict(set)
        self.by_stem: dict[str, set[str]] = defaultdict(set)
        self.by_first: dict[str, set[str]] = defaultdict(set)
        self.by_phrase: dict[str, set[int]] = defaultdict(set)
        seen = set()
        for key, term, count in entries:
            every = tuple(re.findall(r"[^\W_]+", fold(term)))
            words = tuple(w for w in every if w not in SMALL) or every
            joined = "".join(every)
            if not words or (key, joined) in seen:
                continue
            seen.add((key, joined))
            n = len(self.terms)
            self.terms.append((key, words, count))
            for w in set(words):
                self.holding[w].add(n)
                self.by_stem[stem(w)].add(w)
                self.by_first[w[0]].add(w)
            for form in {joined, "".join(words), "".join(words[::-1])}:
                self.by_phrase[form].add(n)
        self.in_order = sorted(self.by_phrase)
        self.words, self.phrases = Deletes(edits_for, self.holding), Deletes(edits_for_phrase, self.by_phrase)

    def near_words(self, word: str) -> dict[str, float]:
        """List words within reach of a word, with their distance; those of the same stem too."""
        out = self.words.near(word)
        root = stem(word)
        hard = root[:-1] + "d" if root.endswith("z") else root  # d turns to z before i
        for s in {root, hard, "a".join(hard.rsplit("e", 1))}:  # and the vowel before it from a to e
            for w in self.by_stem.get(s, ()):
                out[w] = min(out.get(w, 9.0), 0.5)
        return out

    def short_for(self, short: str) -> set[str]:
        """List words that ``short`` may stand for."""
        return {w for w in self.by_first.get(short[0], ()) if _is_short(short, w)}

    def lookup(self, value: str) -> int:
        return decide([self.best(value)])

    def best(self, value: str) -> Best:
        """The best entry of this dictionary by the value's words or as one word, and the entries that a lone shortened word may stand for."""
        plain = fold(_CAMEL.sub(" ", value) if not value.isupper() else value)
        raw = _MARKS.findall(plain)
        dotted = {w[:-1] for w in raw if w.endswith(".")}
        words = [w.rstrip(".") for w in raw]
        words = [w for w in words if w]
        if not words:
            return None, []
        best, shorts = self._by_words(words, dotted)
        if len(words) == 1 and words[0] in dotted and len(words[0]) >= 6:  # several words run together and shortened
            at = bisect.bisect_left(self.in_order, words[0])
            while at < len(self.in_order) and self.in_order[at].startswith(words[0]):
                shorts += [((0, 0.3, -self.terms[n][2], self.terms[n][0]), True) for n in self.by_phrase[self.in_order[at]]]
                at += 1
        glued = self._by_joined("".join(words))
        picks = [p for p in (best, glued) if p is not None]
        return min(picks) if picks else None, shorts

    def _by_words(self, words: list[str], dotted: set[str]) -> Best:
        """Each word of an entry must be matched by its own word of the value; what is left over must be bearable."""
        content = [w for w in words if w not in SMALL or w in dotted] or words
        near = {w: self.near_words(w) for w in set(content)}
        short = {w: self.short_for(w) for w in set(content) if w in dotted or len(w) <= 4}
        candidates = {n for found in (*near.values(), *short.values()) for x in found for n in self.holding[x]}
        best, shorts = None, []
        for n in candidates:
            key, entry, count = self.terms[n]
            left, cost, shortened = list(content), 0.0, 0
            for x in entry:
                options = [(near[w][x], 0, w) for w in left if x in near[w]] + [(0.3, 1, w) for w in left if x in short.get(w, ()) and x not in near[w]]
                if not options:
                    break
                dist, by_short, w = min(options)
                cost, shortened = cost + dist, shortened + by_short
                left.remove(w)
            else:
                over = [w for w in left if w not in QUALIFIERS and not any(c.isdigit() for c in w) and not (near[w] and min(near[w].values()) <= 1 and len(w) <= 3)]
                length = sum(map(len, entry))
                if cost > max(REACH * length, 0) or len(over) > len(entry) or shortened and over:
                    continue
                # Entries that explain more of the value come first.
                rank = (len(over), cost / length + 0.01 * len(left) - 0.02 * len(entry), -count, key)
                if shortened == len(entry) and len(entry) == 1:
                    shorts.append((rank, any(len(w) >= 3 for w in content if entry[0] in short.get(w, ()))))
                elif best is None or rank < best:
                    best = rank
        return best, shorts

    def _by_joined(self, joined: str) -> tuple | None:
        """The value as one word, with qualifying words taken off its ends."""
        forms = {joined, re.sub(r"(?:nr)?\d+$", "", joined) or joined}
        last = forms
        for _ in range(4):
            last = {f[len(q) :] for f in last for q in _ENDS if f.startswith(q) and len(f) - len(q) >= 3} | {f[: -len(q)] for f in last for q in _ENDS if f.endswith(q) and len(f) - len(q) >= 3}
            forms |= last
        best = None
        for f in forms:
            for phrase, dist in self.phrases.near(f).items():
                for n in self.by_phrase[phrase]:
                    key, _, count = self.terms[n]
                    rank = (0, dist / len(phrase) + (0.02 if f != joined else 0.0), -count, key)
                    if best is None or rank < best:
                        best = rank
        return best


def decide(found: list[Best]) -> int:
    """The entry meant, from what each part of the dictionary found; -1 for none. A lone shortened word must point to one entry only."""
    picks = [best for best, _ in found if best is not None]
    shorts = [x for _, some in found for x in some]
    if len({rank[-1] for rank, _ in shorts}) == 1 and any(enough for _, enough in shorts):
        picks.append(min(rank for rank, _ in shorts))
    return min(picks)[-1] if picks else -1


def list_entries(reference: DataFrame, used: DataFrame, key: str, label: str, other: list[str], translations: dict[str, str] = FOREIGN) -> DataFrame:
    """(key, term, n): every term of the list with its key and how often its label is used exactly."""
    counts = used.where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    named = reference.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.concat_ws(";", *other).alias("other"))
    rows = named.join(counts, named["label"] == counts["value"], "left").select("key", "label", "other", F.coalesce("n", F.lit(0)).alias("n"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                terms = [t.strip() for t in [r.label or "", *(r.other or "").split(";")] if t.strip()]
                for t in list(terms):
                    for i, group in enumerate(translations.get(fold(t), "").split(";")):
                        # One-word terms stand side by side in the first place; several words between semicolons are one term.
                        words = group.split()
                        single = i == 0 and len(words) > 1 and not any(w in SMALL for w in map(fold, words))
                        terms += words if single else [group] if group else []
                out += [(r.key, t, r.n) for t in terms]
            yield pd.DataFrame(out, columns=["key", "term", "n"])

    return rows.mapInPandas(expand, "key long, term string, n long").distinct()


_FOUND = T.StructType([T.StructField("value", T.StringType()), T.StructField("best", T.StringType())])


def _find(values: DataFrame, terms: list[tuple[int, str, int]]) -> DataFrame:
    """(value, best): what one part of the dictionary finds for each value, as JSON."""
    sent = values.sparkSession.sparkContext.broadcast(terms)  # no more than PART_TERMS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(tuple(sent.value))
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Dictionary(sent.value)
        for batch in batches:
            yield pd.DataFrame({"value": batch["value"], "best": [json.dumps(_BUILT[key].best(v)) for v in batch["value"]]})

    return values.mapInPandas(run, _FOUND)


#: The part of the dictionary that a worker built last; tasks of the same worker share it.
_BUILT: dict[int, Dictionary] = {}


@F.pandas_udf(T.LongType())
def _decide(found: pd.Series) -> pd.Series:
    return pd.Series([decide([(tuple(b) if b else None, [(tuple(r), e) for r, e in s]) for b, s in map(json.loads, some)]) for some in found], dtype="int64")


def map_values(values: DataFrame, entries: DataFrame | list[tuple[int, str, int]], ignored: tuple[str, ...] = ()) -> DataFrame:
    """Adds type_id to rows with the column ``value``: the key of the entry meant, -1 for none, null where not looked up.
    ``entries`` is (key, term, n)."""
    if isinstance(entries, list):
        entries = values.sparkSession.createDataFrame(entries, "key long, term string, n long")
    values = values.drop("type_id")
    bare = F.lower(F.regexp_replace("value", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    asked = spread(values.select("value").where((bare != "") & ~bare.isin(*ignored)).distinct(), "value")
    size = entries.count()
    if not size:
        mapped = asked.select("value", F.lit(-1).cast("long").alias("type_id"))
    elif size <= PART_TERMS:
        terms = sorted(tuple(r) for r in entries.limit(PART_TERMS).collect())
        found = _find(asked, terms)
        mapped = materialise(found.select("value", _decide(F.array("best")).alias("type_id")), "mapped")
    else:
        parts = -(-size * 5 // (4 * PART_TERMS))  # hashing fills the parts unevenly
        asked = materialise(asked, "asked")
        cut = materialise(entries.withColumn("part", F.pmod(F.xxhash64("key", "term"), F.lit(parts)).cast("int")), "terms", ["part"])
        found = None
        for part in range(parts):
            terms = sorted((r["key"], r["term"], r["n"]) for r in cut.where(F.col("part") == part).collect())  # about PART_TERMS
            some = materialise(_find(asked, terms), "found")
            found = some if found is None else found.unionByName(some)
        # One row a part for each value.
        mapped = materialise(found.groupBy("value").agg(F.collect_list("best").alias("all")).select("value", _decide("all").alias("type_id")), "mapped")
    # The row travels as one column, so whatever its columns are called does no harm.
    packed = values.select(F.col("value").alias("asked"), F.struct("*").alias("row"))
    return packed.join(mapped, packed["asked"] == mapped["value"], "left").select("row.*", "type_id")
