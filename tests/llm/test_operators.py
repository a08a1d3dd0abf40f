import itertools
import os
import random
import re
import types
import unicodedata

import hypothesis
import hypothesis.strategies
import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from dosarium.llm import bpe, canonical_list, confusables, history_dedup, leakage, name_variants, residue, scan_repair, spam

ODD = [None, "", "   ", "x" * 200_000, "\x00﻿", "a\nb\r\tc"]


# 1: deduplication against history

RECORDS = "id long, original_path string, ai_proposed_name string, batch_no int, reason string, canon string, batch int"


def records(spark, rows):
    return spark.createDataFrame([(i, p, n, b, None, "clash", 99) for i, p, n, b in rows], RECORDS)


def links(df):
    return {(r["id"], r["first"]) for r in df.collect()}


def test_dedup_finds_variants_and_keeps_others_apart(spark):
    rows = [
        (1, "/inbox/hr/doc 12300.pdf", "Factură_Zorvelia_2019_12300.pdf", 0),
        (2, "/inbox/hr/doc 12300.pdf", "Notificare_Zorvelia_2019_12300.pdf", 0),
        (3, "/inbox/hr/./Copie a doc 12300.pdf", "Zorvelia Factură 2019 12300 (2).PDF", 1),
        (4, "\\inbox\\hr\\doc 12300.pdf", "Fact_Zorvelia_2019_12300.pdf", 1),
        (5, "/inbox/hr/doc 12300.pdf", "Fatcură_Zorvelіa_2019_12300.pdf", 2),
        (6, "/inbox/hr/doc 12400.pdf", "Factură_Zorvelia_2019_12400.pdf", 2),
        (7, "/inbox/hr/doc 12300.pdf", "Factură_Babzugelia_2019_12300.pdf", 2),
        (8, "/inbox/hr/doc 12300.pdf", "Factură_Babzugelia_2019_12300 - Copie.pdf", 2),
        (9, None, None, 2),
        (10, None, "Factură 77.pdf", 2),
        (11, "", "factură 77.pdf", 3),
    ]
    assert links(history_dedup.dedup_batches(records(spark, rows))) == {(3, 1), (4, 1), (5, 1), (8, 7), (11, 10)}


def test_dedup_of_nothing_and_of_a_hot_group(spark):
    assert links(history_dedup.dedup_batches(records(spark, []))) == set()
    hot = [(i, "/a/scan 5.pdf", f"Factură_Zor{'x' * (i % 2)}velia_5.pdf", i % 2) for i in range(1, 301)]
    hot += [(1000 + i, "/a/scan 5.pdf", f"Factură_Firma{'abcdefghijklmnop'[i] * 4}_5.pdf", 1) for i in range(16)]
    got = history_dedup.dedup_batches(records(spark, hot))
    # Every variant goes to the first record of the history, the other firms to nobody. Record 1 comes after 2 here, so it has no smaller first.
    assert links(got) == {(i, 2) for i in range(3, 301)}


def test_store_is_reopened_and_only_its_matching_partitions_are_read(spark, tmp_path):
    def batch(rows):
        return history_dedup.read_records(records(spark, rows), "id", "original_path", "ai_proposed_name", "batch_no")

    store = history_dedup.History(spark, f"file://{tmp_path}/store", parts=32)
    store.add_batch(batch([(i, f"/in/doc {i * 100}.pdf", f"Factură_Zorvelia_{i * 100}.pdf", 0) for i in range(1, 200)]))
    again = history_dedup.History(spark, f"file://{tmp_path}/store")
    assert (again.parts, again.batches) == (32, 1)
    new = history_dedup.collapse(batch([(900, "/in/doc%20700.pdf", "Factura Zorvelia 700.pdf", 1), (901, "/in/x.pdf", "Aviz 5.pdf", 1)]), []).withColumn("part", again.part())
    parts = [r["part"] for r in new.select("part").distinct().collect()]
    plan = again.probe(new, parts, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (IN|=)", plan) and len(parts) <= 2
    read = {r[0].split("part=")[1].split("/")[0] for r in again.read("keys", parts).select(F.input_file_name()).distinct().collect()}
    assert read <= set(map(str, parts))
    assert links(again.add_batch(batch([(900, "/in/doc%20700.pdf", "Factura Zorvelia 700.pdf", 1), (901, "/in/x.pdf", "Aviz 5.pdf", 1)]))) == {(900, 7)}
    third = history_dedup.History(spark, f"file://{tmp_path}/store")
    assert third.batches == 2 and links(third.add_batch(batch([(950, "/in/x.pdf", "aviz_5 (1).pdf", 2)]))) == {(950, 901)}
    # A batch whose keys were not written completely is no part of the store.
    (tmp_path / "store/keys/batch=2/_SUCCESS").unlink(missing_ok=True)
    assert history_dedup.History(spark, f"file://{tmp_path}/store").batches == 2


def test_empty_batches_and_clashing_columns(spark, tmp_path):
    def batch(rows):
        return history_dedup.read_records(records(spark, rows), "id", "original_path", "ai_proposed_name", "batch_no")

    store = history_dedup.History(spark, f"file://{tmp_path}/store", parts=4)
    assert links(store.add_batch(batch([]))) == set()
    assert links(store.add_batch(batch([(1, "/a/b 7.pdf", "Aviz 7.pdf", 0), (2, None, None, 0)]))) == set()
    assert links(store.add_batch(batch([]))) == set()
    assert links(history_dedup.History(spark, store.path).add_batch(batch([(3, "/a/b 7.pdf", "x" * 100_000 + " 7", 1), (4, "/a/b 7.pdf", "aviz 7 (1).pdf", 1)]))) == {(4, 1)}


def test_a_bucket_of_many_files_that_do_not_match(spark, monkeypatch):
    monkeypatch.setattr(history_dedup, "LEADERS", 2)
    monkeypatch.setattr(history_dedup, "GROWTH", 3)
    rnd = random.Random(4)
    firms: list[str] = []  # no two of them a slip apart
    while len(firms) < 50:
        new = "".join(rnd.choice(p) for p in ("bdfgl", "aeiou", "mnrst", "aeiou", "ckpvz", "aeiou", "bdfgl"))
        firms += [] if any(history_dedup.same_words([new], [f]) for f in firms) else [new]
    rows = [(i, "/arhiva/facturi furnizori/document scanat.pdf", f"Factura_lunara_servicii_{f}.pdf", 0) for i, f in enumerate(firms)]
    rows += [(1000 + i, "/arhiva/facturi furnizori/document scanat.pdf", f"{f}_Factura_lunara_serviciu.pdf", 0) for i, f in enumerate(firms)]
    assert links(history_dedup.dedup_batches(records(spark, rows))) == {(1000 + i, i) for i in range(50)}


def test_batches_without_a_number_come_last(spark):
    rows = [(1, "/a/b 7.pdf", "Aviz 7.pdf", 3), (2, "/a/b 7.pdf", "Aviz 7 copie.pdf", None), (3, "/a/b 8.pdf", "Aviz 8.pdf", None), (3, "/a/b 8.pdf", "Aviz 8.pdf", None), (4, "/a/b 8.pdf", "aviz 8.pdf", None)]
    assert links(history_dedup.dedup_batches(records(spark, rows))) == {(2, 1), (4, 3)}


def test_same_words_against_all_single_slips():
    word = "notificare"
    slips = {word[:i] + word[i + 1 :] for i in range(10)} | {word[:i] + "x" + word[i:] for i in range(11)} | {word[:i] + "x" + word[i + 1 :] for i in range(10)} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(9)}
    assert all(history_dedup.one_slip(word, s) and history_dedup.one_slip(s, word) for s in slips)
    assert not history_dedup.one_slip("sodzorovici", "sodnerovici")
    assert history_dedup.same_words(["contract", "zorvelia"], ["zorvelia", "ctr"]) and not history_dedup.same_words(["aviz", "a"], ["aviz", "b"])


# 2: residue


@pytest.fixture(scope="module")
def finder():
    return residue.Finder([])


@pytest.mark.parametrize("name", ["{{issuer}}.pdf", "2019_${nume_client}_Aviz.pdf", "lorem_ipsum_dolor.docx", "Error 404 - page not found.pdf", "Activați JavaScript pentru a continua.png", "Zorvelia_[Emitent]_2020.pdf", "YYYYMMDD_factura.pdf", "null_null.pdf", "Access denied.txt", "Veuillez activer JavaScript.pdf", "%titlu% contract.pdf", "Beispieltext hier.txt"])
def test_residue_is_found(finder, name):
    assert finder.judge(name)[0]


@pytest.mark.parametrize("name", ["Factură_Zorvelia_2019_12300.pdf", "Raport erori 500 site intern.pdf", "Curs JavaScript avansați.pdf", "Contract [semnat].pdf", "Договор аренды 55.pdf", "Template CV simplu.docx", *[x for x in ODD if x is None or len(x) < 10]])
def test_real_names_are_not_residue(finder, name):
    assert finder.judge(name)[0] is None


def test_a_placeholder_beside_a_bracketed_remark(finder):
    assert finder.judge("Contract (((semnat))) 2020 {{nume client}}.pdf")[0] == "placeholder" and finder.judge("Contract [semnat] [copie].pdf")[0] is None


def test_template_tokens_are_legitimate_in_templates_only(finder):
    assert finder.judge("[An]_[Emitent]_[SubiectAI]", True)[0] is None and finder.judge("[An]_[Emitent]_[SubiectAI]")[0] == "placeholder"
    assert finder.judge("[An]_{{nume}}_[Emitent]", True)[0] == "placeholder"


def test_held_out_phrases(finder):
    """Fields and calls that the models were not fitted on, in wrappings that they were."""
    held = [a + f + b for a, b in (("[", "]"), ("{{", "}}"), ("${", "}"), ("<<", ">>")) for f in ("titlu_nou", "client_nume", "data facturii", "invoice_date", "numele_autorului")]
    assert sum(finder.judge(f"Aviz {h} 2020.pdf")[0] is not None for h in held) >= 0.9 * len(held)


def test_held_out_topics_by_a_model_of_prose(spark):
    """Titles about errors, scripts and templates that stand in no list, against residue beside names that stand in none either."""
    prose = ["Raportul lunar al laboratorului se păstrează în arhivă până la sfârșitul anului. Cursul de muzică pentru copii începe la ora opt, iar planul de lucru al echipei se trimite prin poștă.", "The museum keeps letters and maps of the harbour; every summer the students write notes on trade, weather and ships."] * 30
    natural = residue.natural_grams(spark.createDataFrame([(t,) for t in prose], "text string"))
    found = residue.Finder(natural)
    real = ["Manual JavaScript pentru bunici.pdf", "Ghid erori de zidărie.docx", "Poster Null Island.png", "Template invitație nuntă.docx", "Test de limbă germană.pdf", "Atelier script de teatru 2021.pdf", "Pagini lipsă din album.jpg", "Cookies cu ciocolată.jpg", "Acces la garaj 2020.pdf", "Timeout la baschet.png", "Server de tenis.jpg", "Format A4 hârtie.pdf", "Data nașterii lui Eminescu.txt", "Browser de hărți vechi.pdf", "Sample de sol 12.xlsx"]
    left = ["Muzeul {{autor}} 2020.pdf", "Harta_undefined_undefined.pdf", "Cod eroare 503: serviciu indisponibil.png", "Lorem ipsum dolor sit.docx", "Vă rugăm să activați JavaScript.pdf", "Zandoria - 404 not found.pdf", "[Nume client] contract.docx", "asdf asdf.txt", "Session expired.pdf", "Veuillez activer JavaScript pour continuer.png", "null null null.pdf", "Text exemplu text exemplu.docx", "${title}_2019.pdf", "Internal server error 500.html.pdf", "placeholder name.pdf"]
    wrong, hit = [n for n in real if found.judge(n)[0]], [n for n in left if found.judge(n)[0]]
    assert len(hit) >= 0.9 * len(left) and len(hit) >= 0.9 * (len(hit) + len(wrong)), (wrong, set(left) - set(hit))


def test_rare_grams_keep_their_short_contexts(spark, monkeypatch):
    texts = spark.createDataFrame([("abcabcabd",), ("abcabz",), (None,), ("  ",), ("Ăbc\n99",)], "text string")
    whole = residue.natural_grams(texts)
    expect = residue._count([])
    for t in ("abcabcabd", "abcabz", "abc 00"):
        expect.update(residue.grams(f" {t} "))
    assert dict(whole) == dict(expect)
    monkeypatch.setattr(residue, "MOST_GRAMS", 3)
    cut = residue.natural_grams(texts)
    for size in (1, 2):
        sums = [{}, {}]
        for held, counts in zip(sums, (whole, cut)):
            for g, n in counts:
                held[g[-size:]] = held.get(g[-size:], 0) + n
        assert sums[0] == sums[1]


def test_residue_column(spark):
    df = spark.createDataFrame([(1, "{{x}}", "a", False), (2, None, "a", True), (2, None, "a", True)], "id int, text string, kind string, template boolean")
    rows = residue.find_residue(df, df.select(F.lit("natural text").alias("text")), "text", "template").collect()
    assert len(rows) == 3 and rows[0]["kind"] == "a"
    clash = spark.createDataFrame([("{{issuer}}.pdf", "a", "b", "c", 1.0)], "name string, text string, template string, residue string, score double")
    row = residue.find_residue(clash, df.select(F.lit("natural text").alias("text")), "name").collect()[0]
    assert row["residue"]["kind"] and row["text"] == "a" and row["score"] == 1.0
    assert residue.find_residue(df.limit(0), df.select("text").limit(0), "text").isEmpty()


# 3: canonical list

ENTRIES = [(1, "factură", 50), (1, "invoice", 0), (2, "contract de muncă", 5), (3, "contract de închiriere", 5), (4, "carte de identitate", 1), (4, "buletin", 0), (5, "analize de laborator", 1), (5, "buletin de analize", 0)]


@pytest.mark.parametrize(
    "value, key",
    [("Factura", 1), ("fatcură", 1), ("faactura (copie)", 1), ("INVOICE nr 7", 1), ("contractdemuncă", 2), ("ctr. munca", 2), ("muncă contract", 2), ("contracte de inchiriere", 3), ("buletin", 4), ("buletin de analize", 5), ("origami", -1), ("???", -1), ("x" * 5000, -1), ("carte de citit", -1)],
)
def test_values_are_mapped(value, key):
    assert canonical_list.Dictionary(ENTRIES).lookup(value) == key


def test_lookup_against_brute_force():
    terms = [("".join(random.Random(i).choices("abcdefgh", k=9)), i) for i in range(40)]
    d = canonical_list.Dictionary([(k, t, 0) for t, k in terms])
    rnd = random.Random(5)
    for t, k in terms:
        i = rnd.randrange(8)
        for wrong in (t[:i] + t[i + 1 :], t[:i] + t[i + 1] + t[i] + t[i + 2 :], t[:i] + "z" + t[i + 1 :]):
            near = min((canonical_list.weighted_distance(wrong, u), n) for u, n in terms)
            assert d.lookup(wrong) == near[1] == k


def test_every_word_within_reach_is_found_wherever_its_slips_are():
    def random_edit(rnd, w):
        i = rnd.randrange(len(w) + 1)
        return rnd.choice([w[:i] + rnd.choice("abcdefgx") + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice("abcdefgx") + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])

    rnd = random.Random(9)
    for allowed in (canonical_list.edits_for, canonical_list.edits_for_phrase):
        words = {"".join(rnd.choices("abcdefg", k=rnd.choice([2, 3, 4, 6, 9, 12, 14, 30, 39, 41, 60]))) for _ in range(150)}
        index = canonical_list.Deletes(allowed, words)
        for w in sorted(words):
            asked = w
            for _ in range(rnd.randint(0, 4)):
                asked = random_edit(rnd, asked)
            if asked:
                assert set(index.near(asked)) == {x for x in words if canonical_list.edits(asked, x, 9) <= min(allowed(x), allowed(asked))}


@pytest.mark.parametrize("value", ["reconciliatxx", "rexonciliatixn", "rxconciliaton"])
def test_slips_at_any_place_count_alike(value):
    assert canonical_list.Dictionary([(1, "reconciliation", 1), (2, "registration", 9)]).lookup(value) == 1


def test_a_list_in_several_parts_gives_what_one_part_gives(spark, monkeypatch):
    rnd = random.Random(3)
    entries = [(k, "".join(rnd.choices("abcdefgh", k=rnd.choice([4, 7, 12]))) + rnd.choice(["", " de acte", " munca"]), rnd.randint(0, 3)) for k in range(120)]
    values = [t for _, t, _ in entries] + [t[:2] + "x" + t[3:] for _, t, _ in entries] + [t[:3] + "." for _, t, _ in entries] + ["origami", " ANY\u00a0"]
    df = spark.createDataFrame([(v, "x") for v in values], "value string, best string")
    one = {tuple(r) for r in canonical_list.map_values(df, entries, ("any",)).collect()}
    monkeypatch.setattr(canonical_list, "PART_TERMS", 30)
    assert {tuple(r) for r in canonical_list.map_values(df, entries, ("any",)).collect()} == one and len({r[2] for r in one}) > 100


def test_mapping_of_rows(spark):
    df = spark.createDataFrame([(1, "Factură"), (2, None), (3, " any "), (4, ""), (5, "origami")], "type_id2 int, value string")
    assert [r["type_id"] for r in canonical_list.map_values(df, ENTRIES, ("any",)).collect()] == [1, None, None, None, -1]
    assert [r["type_id"] for r in canonical_list.map_values(df, [], ("any",)).collect()] == [-1, None, None, None, -1]
    clash = spark.createDataFrame([("Factură", 9, "k", "b"), ("Factură", 9, "k", "b"), ("z" * 100_000, 9, "k", "b")], "value string, type_id int, key string, __value string")
    assert sorted(r["type_id"] for r in canonical_list.map_values(clash, ENTRIES).collect()) == [-1, 1, 1]


# 4: name variants


def groups(spark, rows):
    got = name_variants.link_spellings(spark.createDataFrame(rows, "kind string, value string"))
    return {frozenset(r["v"]) for r in got.groupBy("root").agg(F.collect_set("value").alias("v")).collect()}


def test_spellings_are_linked(spark):
    persons = ["Ulrich Dranplimanu", "DRANPLIMANU, Ulrich", "Dranplimanu U.", "dr. Ulrich Dranplimanu", "Ulrich G. Dranplimanu", "Uli Dranplimanu", "Ulrcih Dranplimanu"]
    others = ["Bogdan Dranplimanu", "Bogdi Dranplimanu"]
    rows = [("person", v) for v in [*persons, *others, None, "", "N/A", "Ulrich Dranplimanu"]]
    rows += [("organisation", v) for v in ("Zorvelia Energie SA", "S.C. Zorvelia-Energie S.A.", "ZorveliaEnergie SA", "Zorvelia En. SA", "Zorvelia", "Babzugelia Energie SA", "Babzugelia Transport SA", "Babzugelia")]
    assert groups(spark, rows) == {frozenset(persons), frozenset(others), frozenset(["Zorvelia Energie SA", "S.C. Zorvelia-Energie S.A.", "ZorveliaEnergie SA", "Zorvelia En. SA", "Zorvelia"]), frozenset(["Babzugelia Energie SA"]), frozenset(["Babzugelia Transport SA"]), frozenset(["Babzugelia"])}
    assert groups(spark, []) == set()


def test_common_suffix_and_hot_group_against_brute_force(spark):
    rnd = random.Random(2)
    firsts = ["Ulrich", "Bogdan", "Felicia", "Yolanda", "Raymond"]
    names = [f"{f} {''.join(rnd.choices('bdfgklmnprstvz', k=4))}escu" for f in firsts for _ in range(25)]
    hot = "Octavian Plimtolescu"
    names += [hot] + [hot[:i] + c + hot[i + 1 :] for i in range(1, 8) for c in "bcdfghjklmnp" if c != hot[i]]
    words = {v: name_variants.read_name(v, True)[0] for v in names}
    parent = {v: v for v in words}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(words, 2):
        if name_variants.same_full(words[a], words[b]):
            parent[root(a)] = root(b)
    expect = {}
    for v in words:
        expect.setdefault(root(v), set()).add(v)
    assert groups(spark, [("person", v) for v in names]) == {frozenset(g) for g in expect.values()}


def test_slips_beside_a_common_word(spark):
    rnd = random.Random(8)
    # Many names share the word, also its ends with the slips, so that no block is small.
    crowd = {"".join(rnd.choice(p) for p in ("bcdfgjklp", "aeiou", "rstvz", "aeiou", "bdgmn")) for _ in range(400)}
    names = [f"{w.capitalize()} Popescu" for w in sorted(crowd)][:120]
    near = [("Marfa Popescu", "Mafa Popescu"), ("Qwxyh Popescu", "Qwyh Popescu"), ("Wolfyz Popescu", "Popescu Woflyz"), ("Popescu Xanq Hwxyq", "Xanq Hwxyq Popescu"), ("Popescu Jyyq Vwxyqw", "Jyyq Popescu Vwyqw")]
    names += [v for pair in near for v in pair]
    got = groups(spark, [("person", v) for v in names])
    for a, b in near:
        assert any({a, b} <= g for g in got), (a, b)


@pytest.mark.parametrize("size", [10, 58, 59, 60, 61, 300])
def test_links_do_not_depend_on_how_common_a_word_is(spark, size):
    rnd = random.Random(size)
    crowd = [f"mesten {''.join(rnd.choices('bdfgklmnprstvz', k=7))} tolvar" for _ in range(size - 2)]
    long = "".join(rnd.choices("abcdefghij", k=150))
    names = [*crowd, "tolvar mesten zorvelescu", "mesten zorvelesci tolvar", f"tolvar {long[1:]}", f"{long[:-1]} tolvar", f"tolvar {long[:100]}", f"tolvar {long[:101]}", f"tolvar {long[:99]}x"]
    got = groups(spark, [("person", v) for v in names])
    assert frozenset(names[-7:-5]) in got and frozenset(names[-5:-3]) in got and frozenset(names[-3:]) in got


def test_long_values(spark):
    long = "Abcdefghij" * 5_000
    assert groups(spark, [("person", v) for v in (f"Ulrich {long}", f"Ulrich {long[:777]}x{long[778:]}", f"Bogdan {long}", "y" * 100_000)]) == {frozenset([f"Ulrich {long}", f"Ulrich {long[:777]}x{long[778:]}"]), frozenset([f"Bogdan {long}"]), frozenset(["y" * 100_000])}
    wide = spark.createDataFrame([(1, "\n".join(["x" * 100_000, "_" * 100_000, " " * 50_000, "x" * 100_000 + "-"]), 2)], "input_id long, document_text string, n_pages int")
    assert scan_repair.scan_noise(wide).where("kind != 'hyphen'").isEmpty()
    odd = spark.createDataFrame([(1, "x" * 200_000), (2, "[" * 50_000), (3, "a b " * 50_000)], "doc_id long, text string")
    assert spam.incoherent_pages(odd).count() == 1


def test_nothing_is_broadcast_to_link_spellings(spark, monkeypatch):
    plans, written = [], name_variants.materialise

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(name_variants, "materialise", noted)
    crowd = [f"{c}{d}tolvar Plimtolescu" for c in "bcdfghjk" for d in "aeioulmn"]
    values = spark.createDataFrame([("person", v) for v in [*crowd, "Plimtolescu B."]], "kind string, value string")
    pairs = name_variants.all_pairs(name_variants.link_spellings(values))
    plans.append(pairs._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 8 and not any("Broadcast" in p for p in plans)


def test_common_subsequence():
    def brute(a, b):
        return max((k for k in range(len(a) + 1) for s in itertools.combinations(a, k) if re.search(".*".join(map(re.escape, s)), b)), default=0)

    rnd = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 6))) for _ in range(2))
        assert name_variants.common_length(a, b) == brute(a, b)


# 5: look-alikes


@pytest.mark.parametrize("value, form", [("Ｃｏｎｔｒａｃｔ", "Contract"), ("Сurs", "Curs"), ("Şcoala ţării", "Școala țării"), ("ă", "ă"), ("a​b c", "ab c"), ("2019‑10", "2019-10"), ("ﬁnal", "final"), ("Договор аренды", "Договор аренды"), ("請求書 9", "請求書 9"), ("Straße", "Straße"), ("  x  ", "  x  "), ("", ""), (None, None)])
def test_consistent_form(value, form):
    assert confusables.consistent(value) == form and confusables.consistent(form) == form
    assert confusables.skeleton(value) == confusables.skeleton(form)


def test_look_alikes_of_every_alphabet(spark):
    table = confusables.prototype_table(spark)
    if not table:
        pytest.skip("no look-alike data on this cluster")
    looks = confusables.Lookalikes(table)
    for value, form in {"Տcan": "Scan", "Ꮯontract": "Contract", "cօntrol": "control", "ᴄontract": "contract", "ꓚontract": "Contract", "cⲟntract": "contract", "ƅilet": "bilet", "Ꭵnvoice": "Invoice", "ϹOΝTRΑCT": "CONTRACT", "Дoгoвop": "Договор", "請求書PDF": "請求書PDF", "Łódź": "Łódź", "Ωmega": "Ωmega"}.items():
        got, mixed = looks.read(value)
        assert (got, mixed) == (form, value == "Ωmega") and looks.skeleton(got) == looks.skeleton(value)
    df = spark.createDataFrame([(i, v) for i, v in enumerate("Տcan Ꮯontract cօntrol ᴄontract ꓚontract cⲟntract Ꭵnvoice ƅilet Ωmega Contract Договор".split())], "id long, v string")
    assert {r["rec_id"] for r in confusables.changed_records(df, "v", "id").collect()} == set(range(9))


@pytest.mark.parametrize("reads", [None, "fails", lambda text: text[:-2], lambda text: text], ids=["no library", "fails", "cut", "no prototypes"])
def test_look_alike_data_that_cannot_be_read_is_an_error(spark, reads):
    def failing(text):
        raise Py4JError("refused")

    checker = types.SimpleNamespace(getSkeleton=failing if reads == "fails" else reads)
    there = types.SimpleNamespace(Builder=lambda: types.SimpleNamespace(build=lambda: checker))
    text = types.SimpleNamespace(SpoofChecker=there if reads else spark._jvm.com.ibm.absent.SpoofChecker)
    jvm = types.SimpleNamespace(com=types.SimpleNamespace(ibm=types.SimpleNamespace(icu=types.SimpleNamespace(text=text))))
    broken = types.SimpleNamespace(sparkContext=types.SimpleNamespace(), _jvm=jvm)
    for _ in range(2):  # nor is a failure kept as the data
        with pytest.raises(RuntimeError, match="look-alike data cannot be read"):
            confusables.prototype_table(broken)


@hypothesis.settings(max_examples=300, deadline=None)
@hypothesis.given(hypothesis.strategies.text(alphabet="aeocpxyABCEHIKMTșţăВСорауехіΑΒορνυОօ ﬁ０１ｃ\u200b\u0301-‑", max_size=12))
def test_forms_keep_the_skeleton_and_are_consistent_themselves(text):
    form = confusables.consistent(text)
    assert confusables.skeleton(form) == confusables.skeleton(text) and confusables.consistent(form) == form


def test_groups_and_changed_records(spark):
    rows = [(1, "Curs", "a"), (2, "Сurs", "b"), (2, "Сurs", "b"), (3, None, "c"), (4, "", "d"), (5, "х" * 100_000 + "a", "e")]
    df = spark.createDataFrame(rows, "id long, v string, skeleton string")
    assert {r["rec_id"] for r in confusables.changed_records(df, "v", "id").collect()} == {2, 5}
    assert {r["value"]: r["originals"] for r in confusables.lookalike_groups(df, "v").collect()}["Curs"] == 2
    assert confusables.changed_records(df.limit(0), "v", "id").isEmpty()


# 6: scanned text

PAGE = """Arhiva Zorvelia, 2026
Copia contractului se păstrează în arhiva de la subsol și la regis-
tratură. Suma se achită până la 12.05.2023, în self-
service, iar factura necesită o nouă verificare.
~ 1 ~
Arhiva  Zorvelia, 2026
1966

Suma de 100 lei se achită, iar factura nec¬
esită o nouă verificare. Sumo se achită pârnă la 2O23-10-08.
~ 2 ~"""


def test_scan_noise(spark):
    common = "Suma se achită până la registratură. Factura necesită o nouă verificare prin self-service. " * 12
    rows = [(1, PAGE, 2, "x"), (2, common, 1, "y"), (3, None, 1, "z"), (4, "", None, "z")]
    df = spark.createDataFrame(rows, "input_id long, document_text string, n_pages int, line string")
    got = {(r["line_no"], r["kind"]) for r in scan_repair.scan_noise(df).where("input_id = 1").collect()}
    assert {(1, "header"), (6, "header"), (5, "page_number"), (11, "page_number"), (2, "hyphen"), (9, "hyphen"), (10, "misread")} == got
    text = {r["input_id"]: r["text"] for r in scan_repair.repair(df).collect()}
    assert "registratură" in text[1] and "self-service" not in text[1].split("\n")[0][:60] and "necesită o nouă verificare. Suma se" in text[1] and "2023" in text[1] and "~" not in text[1]
    assert text[3] == "" and text[4] == ""
    assert scan_repair.scan_noise(df.limit(0)).isEmpty()


def test_running_lines_that_turn_miss_a_page_or_stand_inside():
    def text(heads, top=True, numbers=False, height=12):
        rnd, lines = random.Random(3), []
        for k, head in enumerate(heads, 1):
            page = [" ".join(rnd.choices(["livrarea", "suma", "avizul", "termenul", "bugetul", "raportul", "semnat", "ieri"], k=6)) for _ in range(height)]
            at_top = top if k > 1 else not top
            lines += ([head] if at_top and head else []) + page + ([head] if not at_top and head else []) + ([f"~ {k} ~"] if numbers else [])
        return "\n".join(lines)

    def heads(t, pages):
        lines = t.split("\n")
        return {lines[i - 1] for i, place, *_ in scan_repair.read_lines(t, pages) if place == "header"}

    for numbers in (False, True):
        assert heads(text(["Arhiva Nord, 2026"] * 4, numbers=numbers), 4) == {"Arhiva Nord, 2026"}
        turning = ["Zorvelia | confidențial", "REGISTRUL", "Zorvelia | confidențial", "REGlSTRUL", "Zorvelia | confidențial", "REGISTRUL"]
        assert heads(text(turning, numbers=numbers), 6) == set(turning)
    missing = text(["NOTA INTERNĂ"] * 2 + [""] + ["NOTA INTERNĂ"] * 2, numbers=True)
    assert heads(missing, 5) == {"NOTA INTERNĂ"}
    smudged = text(["Arhiva Nord, 2026"] * 3 + ["Arniwa Nerd, 2026"] + ["Arhiva Nord, 2026"], numbers=True)
    assert heads(smudged, 5) == {"Arhiva Nord, 2026", "Arniwa Nerd, 2026"}
    # Headings with numbers of their own, and sums that come again inside pages, belong to the content.
    inside = text([""] * 4, numbers=True).split("\n")
    for k, at in enumerate((5, 20, 31, 46)):
        inside[at] = "Total: 4"
    assert heads("\n".join(inside), 4) == set()


def test_running_lines_with_a_digit_in_a_word_and_of_any_length():
    rnd = random.Random(5)
    words = ["livrarea", "suma", "avizul", "termenul", "bugetul", "raportul", "semnat", "ieri"]
    for head in ("Arhiva Hattromonic, 2024", "Registrul general al arhivei " + " ".join(f"{w}{i}" for i in range(60) for w in ("camera", "raft"))):
        lines = []
        for k in range(4):
            lines += [head if k != 2 else head.replace("o", "0", 1).replace("e", "c", 1)] + [" ".join(rnd.choices(words, k=40 if len(head) > 300 else 6)) for _ in range(12)]
        found = scan_repair.running_lines(lines, 4, set())
        assert found == {0, 13, 26, 39}, head[:40]


def test_page_number_lines():
    lines = ["text of the first page", "- 1 -", "more text here", "- 2 -", "_" * 5000 + " 3 " + "_" * 5000, "x" * 5000 + " 3", "- 3 -"]
    assert scan_repair.page_numbers(lines, 3) == {1, 3, 6}
    assert scan_repair.page_numbers(["pagina 1 din 2", "a 1", "pagina 2 din 2"], 2) == {0, 2}


def test_edit_distance_in_a_band():
    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    rnd = random.Random(8)
    for _ in range(400):
        a, b = ("".join(rnd.choices("ab", k=rnd.randint(0, 7))) for _ in range(2))
        for most in range(5):
            assert scan_repair.alike(a, b, most) == (whole(a, b) <= most)


def test_numbers_by_their_shape_and_texts_of_one_id_apart(spark):
    clean = "Suma de 1200 lei se achită la 12.05.2023, factura 77 din 2022. " * 5
    rows = [(1, clean, 1, "x"), (2, "Nota 2O23 la 1l.05.2024 și 8S lei\nType XO1Z5 stays", 1, "y"), (2, "Alt text 2021\ncu l2OO lei", 1, "y"), (2, "Alt text 2021\ncu l2OO lei", 1, "y"), (3, "O O O", 1, "z")]
    df = spark.createDataFrame(rows, "input_id long, document_text string, n_pages int, text_id string")
    got = {(r["input_id"], r["line_no"], r["kind"]) for r in scan_repair.scan_noise(df).collect()}
    assert got == {(2, 1, "misread"), (2, 2, "misread")}
    texts = sorted(r["text"] for r in scan_repair.repair(df).where("input_id = 2").collect())
    assert texts == ["Alt text 2021 cu 1200 lei", "Nota 2023 la 11.05.2024 și 85 lei Type XO1Z5 stays"]


def test_anagram_hash(spark):
    df = spark.createDataFrame([("anna",), ("nana",), ("hello",), ("he11o",), ("",), ("x" * 100_000,)], "w string").select("w", scan_repair.anagram_hash(F.col("w")).alias("h"), scan_repair.anagram_hash(F.lit("l")).alias("l"), scan_repair.anagram_hash(F.lit("1")).alias("one"))
    h = {r["w"]: r for r in df.collect()}
    assert h["anna"]["h"] == h["nana"]["h"] and h["hello"]["h"] - h["he11o"]["h"] == 2 * (h[""]["l"] - h[""]["one"]) and h[""]["h"] == 0


# 7: tokens


@pytest.fixture(scope="module")
def encoders():
    if not os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.json"):
        pytest.skip("no vocabulary here")
    from tokenizers import Tokenizer

    own = bpe.Encoder(open(f"{bpe.TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8").read())
    library = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    return own, library


def test_ids_equal_the_library(encoders):
    own, library = encoders
    rnd = random.Random(1)
    texts = ["a" * 5000, "ab" * 4999 + "c", " " * 3000 + "x", "ș" * 2000, "<|endoftext|> it's 12:30\r\n", "", "日本語 😀"]
    texts += ["".join(rnd.choices("abcdefgh tion ing 12.,aăîșțéü😀日​\n\t's<|endoftext|>", k=rnd.randint(1, 80))) for _ in range(2000)]
    assert all(own.encode(t) == library.encode(t, add_special_tokens=False).ids for t in texts)


def test_ids_of_rows(spark, encoders):
    own, _ = encoders
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate([*ODD, "x", "x"])], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df).collect()}
    assert got == {i: own.encode(t) for i, t in enumerate([*ODD, "x", "x"])}
    assert bpe.encode_corpus(df.limit(0)).isEmpty()


# 8: leakage


def plain_words(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", t)


def test_passages_against_brute_force(spark):
    rnd = random.Random(4)
    pool = ["alfa", "beta", "gama", "Été", "șir", "x1", "den", "io"]
    items = [(i, " ".join(rnd.choices(pool, k=rnd.choice([3, 12, 20, 30])))) for i in range(8)]
    docs = []
    for d in range(60):
        item = items[rnd.randrange(8)][1].split()
        n, at = rnd.choice([5, 11, 12, 14]), rnd.randrange(max(1, len(item) - 5))
        docs.append((d, " ".join(rnd.choices(pool, k=9)) + "\n" + ",  ".join(item[at : at + n]).upper() + " - " + " ".join(rnd.choices(pool, k=9)), "t"))
    docs += [(100, None, "t"), (101, "", "t"), (102, docs[0][1], "t")]
    expect = set()
    for d, t, _ in docs:
        w = plain_words(t or "")
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        expect |= {(d, i) for i, x in items for k in range(len(plain_words(x)) - 11) if tuple(plain_words(x)[k : k + 12]) in grams}
    got = leakage.find_passages(spark.createDataFrame(docs, "doc_id long, text string, term string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == expect and expect
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leakage.find_passages(empty, spark.createDataFrame(items, "item_id long, text string")).isEmpty()


def test_proximity(spark):
    item = "nine damp ledgers were found beside the lift after dusk"
    docs = [(1, "after dusk nine ledgers were found damp beside a lift the"), (2, "nine ledgers " + "filler " * 60 + "damp found beside lift dusk"), (3, None)]
    got = leakage.find_near(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(1, 7)]


def test_proximity_against_brute_force(spark):
    rnd = random.Random(5)
    items = [(0, "alfa beta gama delta omega"), (1, "unu doi trei patru cinci sase sapte opt noua zece")]
    docs = []
    for d in range(80):
        words = items[d % 2][1].split()
        kept = rnd.sample(words, max(1, len(words) * rnd.choice([6, 8, 8, 10]) // 10))
        text = [w for x in kept for w in [x, *["z"] * rnd.choice([0, 0, 1, 2])]]
        docs.append((d, " ".join(["y"] * rnd.randrange(30) + text)))
    expect = set()
    for d, t in docs:
        for i, x in items:
            terms, w = set(x.split()), t.split()
            most = max(len(terms & set(w[k : k + 2 * len(terms)])) for k in range(len(w)))
            expect |= {(d, i, most)} if 10 * most >= 8 * len(terms) else set()
    got = leakage.find_near(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], round(r["share"] * len(items[r["item_id"]][1].split()))) for r in got.collect()} == expect and expect


# 9: spam


def test_incoherent_pages(spark):
    rnd = random.Random(6)
    nouns, verbs, ends = ["raportul", "dosarul", "avizul", "planul"], ["se păstrează în arhivă", "a fost înregistrat ieri", "necesită o nouă verificare"], ["până luni dimineață", "fără taxe suplimentare", "la sediul central"]
    prose = [" ".join(f"{rnd.choice(nouns).capitalize()} {rnd.choice(verbs)} {rnd.choice(ends)}." for _ in range(8)) for _ in range(80)]
    keys = ["toner ieftin", "dosare", "scanare", "formulare online", "notar", "copii xerox"]
    bad = [" | ".join(rnd.choices(keys, k=60)), " ".join(rnd.choices(keys, k=80)), "\n".join(f"http://x{i}.test/a" for i in range(40)), "#a #b #c " * 20]
    invoice = prose[0] + "\n" + "\n".join(f"{i}. toner x {i} = {i}00,50" for i in range(1, 40))
    rows = [(i, t, "x") for i, t in enumerate(prose)] + [(1000 + i, t, "x") for i, t in enumerate(bad)] + [(2000, invoice, "x"), (2001, None, "x"), (2002, "", "x"), (2003, "toner toner", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, share string")
    assert {r["doc_id"] for r in spam.incoherent_pages(df).where("spam").collect()} == {1000, 1001, 1002, 1003}
    assert spam.incoherent_pages(df.limit(0)).isEmpty()


def test_spam_in_the_shape_of_lists(spark):
    rnd = random.Random(6)
    nouns, verbs = ["raportul", "dosarul", "avizul", "planul"], ["se păstrează în arhivă", "a fost înregistrat ieri", "necesită o nouă verificare"]
    prose = [" ".join(f"{rnd.choice(nouns).capitalize()} {rnd.choice(verbs)} până luni." for _ in range(8)) for _ in range(60)]
    keys = ["toner ieftin", "dosare", "scanare", "formulare online", "notar", "copii xerox"]
    bad = ["\n".join(f"- https://x{i}.test/a" for i in range(40)), "\n".join(f"{i}. [Link {i}](http://x{i}.test)" for i in range(40)), "\n".join("* " + " ".join(rnd.choices(keys, k=3)) for _ in range(40)), "\n".join("| " + " | ".join(rnd.choices(keys, k=5)) + " |" for _ in range(20)), "• #a #b #c\n" * 20]
    good = ["\n".join(f"- {a} {b}" for a, b in zip("abcdefghij" * 2, (f"nume{'xyzw'[i % 4] * (i + 1)}" for i in range(20)))), "\n".join(f"{i}. toner x {i} = {i}00,50" for i in range(1, 40)), "\n".join(f"{i}. Capitolul despre arhive {i * 3}" for i in range(1, 30)), "\n".join(f"- {p.split('.')[0]}" for p in prose[:20])]
    rows = [(i, t) for i, t in enumerate(prose)] + [(1000 + i, t) for i, t in enumerate(bad)] + [(2000 + i, t) for i, t in enumerate(good)]
    got = spam.incoherent_pages(spark.createDataFrame(rows, "doc_id long, text string")).where("spam")
    assert {r["doc_id"] for r in got.collect()} == {1000, 1001, 1002, 1003, 1004}


def test_hot_bigrams_are_split_off_without_a_change(spark, monkeypatch):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["toner", "dosar", "aviz", "plan", "raport"], k=40)) for _ in range(40)] + ["\n".join(["http://x.test/a"] * 60), "#a #b " * 40, None, "", "unu doi"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: (round(r["share"], 9), round(r["mean_pmi"], 9), r["spam"]) for r in spam.incoherent_pages(df).collect()}
    monkeypatch.setattr(spam, "BROADCAST_BIGRAMS", 3)
    monkeypatch.setattr(spam, "MOST_FREQUENT", 20)
    assert {r["doc_id"]: (round(r["share"], 9), round(r["mean_pmi"], 9), r["spam"]) for r in spam.incoherent_pages(df).collect()} == whole and len(whole) == 42


def test_pairs_against_a_plain_count():
    rnd = random.Random(3)
    text = "\n".join(" ".join(rnd.choices(["a", "bb", "c", "d1", "12", "http://x.y", "#t"], k=rnd.choice([3, 12, 40]))) for _ in range(12))
    signs = spam._Signs()
    rows = spam._pairs(7, text, signs)
    expect = {}
    own = {}
    for words, _ in spam.stretches(text):
        for w in words:
            own[w] = own.get(w, 0) + 1
    for i, (words, _) in enumerate(spam.stretches(text)):
        for a, b in zip(words, words[1:]) if len(words) >= 4 else ():
            key = (i, signs[a], signs[b])
            expect[key] = (expect.get(key, (0, 0))[0] + 1, own[b])
    assert {(int(r[1]), int(r[3]), int(r[4])): (int(r[5]), int(r[6])) for r in rows.T if r[5]} == expect and set(rows[0]) == {7}


def test_shuffled_pages_are_incoherent_and_others_stay(spark):
    rnd = random.Random(6)
    nouns, verbs, ends = ["raportul", "dosarul", "avizul", "planul", "bugetul"], ["se păstrează în arhivă", "a fost înregistrat ieri", "necesită o nouă verificare", "ajunge prin poștă"], ["până luni dimineață", "fără taxe suplimentare", "la sediul central", "cu toate anexele"]
    prose = [" ".join(f"{rnd.choice(nouns).capitalize()} {rnd.choice(verbs)} {rnd.choice(ends)}." for _ in range(12)) for _ in range(150)]
    salad = []
    for p in prose[:10]:
        words = re.findall(r"\w+", p)
        rnd.shuffle(words)
        salad.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(prose + salad)), "doc_id long, text string")
    got = {r["doc_id"] for r in spam.incoherent_pages(df).where("spam").collect()}
    assert len(got & set(range(150, 160))) >= 9 and len(got - set(range(150, 160))) <= 1


def test_stretches_keep_every_pair():
    text = "unu doi trei patru cinci șase șapte opt nouă zece unsprezece doisprezece " * 9
    words = [w for w in text.split()]
    pairs = [p for ws, _ in spam.stretches(text) for p in zip(ws, ws[1:])]
    assert pairs == list(zip(words, words[1:]))
