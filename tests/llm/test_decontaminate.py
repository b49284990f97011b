import random

import pytest

from tempora.llm import decontaminate as D

ITEMS = "item_id long, text string, doc_id long, windows long"
ITEM = "A farmer has 120 apples and sells 45 of them to Maria for 3 dollars each, then Maria gives 45 apples to Peter before noon on the same day"


def find(spark, make_docs, rows, items=((1, ITEM),)):
    bench = spark.createDataFrame([(i, t, 0, 0) for i, t in items], ITEMS)
    return {(r["doc_id"], r["item_id"]): r for r in D.find(make_docs(rows), bench).collect()}


def changed(text, **words):
    for a, b in words.items():
        text = text.replace(a.strip("_"), b)
    return text


def test_copies_and_new_parameters_are_found(spark, make_docs):
    new = changed(ITEM, _120="300", _45="71", Maria="Olga", Peter="Ivan", _3="9")
    mixed = ITEM.replace("45 apples to Peter", "46 apples to Peter").replace("45 of", "45 of")
    filler = " ".join(f"filler{n}" for n in range(50))
    rows = [(1, f"{filler}. {ITEM} {filler}"), (2, f"{filler} {new} {filler}"), (3, mixed), (4, filler), (5, None), (6, ""), (None, ITEM), (7, ITEM.replace("\n", " ").upper())]
    got = find(spark, make_docs, rows)
    assert got[1, 1]["exact"] and not got[2, 1]["exact"] and got[None, 1]["exact"]
    # one edited number leaves the windows around it, and a copy in capitals is a copy
    assert (3, 1) in got and got[7, 1]["exact"] and (4, 1) not in got


def test_short_items_are_one_window(spark, make_docs):
    got = find(spark, make_docs, [(1, "well, seven green bottles stood upon walls today"), (2, "seven green bottles stood")], [(5, "seven green bottles stood upon walls"), (6, "too short"), (7, None), (8, "")])
    assert set(got) == {(1, 5)}


def test_items_of_a_few_tokens_are_found(spark, make_docs):
    items = [(1, "What is 17 plus 5 ?"), (2, "Name Oslo"), (3, "?"), (4, None)]
    rows = [(1, "so what is 17 plus 5 then"), (2, "well: what is 40 plus 2"), (3, "what was 17 plus 5"), (4, "please NAME oslo now"), (5, "name the oslo")]
    got = find(spark, make_docs, rows, items)
    assert set(got) == {(1, 1), (2, 1), (4, 2)} and got[1, 1]["exact"] and not got[2, 1]["exact"]


def brute_templates(rows, items, window=13):
    """Documents and items that share a window of tokens: equal but for case, or as templates with slot values one to one. Token by token, without hashes."""
    import regex

    def read(text):
        out, stop, number = [], True, False
        for t in regex.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°]|[.!?\n]", text or ""):
            low = t.lower()
            if t in ".!?\n":
                stop, number = True, False
                continue
            if t[0].isdecimal():
                out.append((low, "<number>", "n" + t.replace(",", "")))
            elif low in D.UNITS and (number or not t[0].isalpha()):
                out.append((low, "<unit>", "u" + low))
            elif t[0].isupper() and len(t) > 1 and not stop:
                out.append((low, "<name>", "a" + low))
            else:
                out.append((low, low, None))
            stop, number = False, t[0].isdecimal()
        return out

    found = set()
    for i, item in items:
        x = read(item)
        w = min(window, len(x))
        for d, text in rows:
            y = read(text)
            for a in range(len(x) - w + 1 if w else 0):
                for b in range(len(y) - w + 1):
                    p, q = x[a : a + w], y[b : b + w]
                    if [t[0] for t in p] == [t[0] for t in q]:
                        found.add((d, i))
                    elif [t[1] for t in p] == [t[1] for t in q] and 2 * sum(t[2] is not None for t in p) <= w:
                        pairs = {(s[2], t[2]) for s, t in zip(p, q) if s[2]}
                        if len({s for s, _ in pairs}) == len(pairs) == len({t for _, t in pairs}):
                            found.add((d, i))
    return found


def test_templates_match_brute_force(spark, make_docs):
    """Items with numbers, units and names, quoted, re-cased, re-parameterised consistently or not."""
    rnd = random.Random(12)
    words = "red boat river stone grain paper cloud lamp chair wheel garden bread".split()
    names = ["Anna", "Boris", "Carla", "Dmitri", "Elena"]
    token = lambda: rnd.choice([rnd.choice(words), rnd.choice(words), rnd.choice(words), str(rnd.randint(2, 9)), f"{rnd.randint(2, 9)} km", rnd.choice(names)])
    items = [(n, " ".join(token() for _ in range(rnd.choice([3, 8, 20])))) for n in range(14)]
    rows = []
    for d in range(90):
        body = rnd.choice(items)[1].split()
        for at in range(len(body)):
            if rnd.random() < 0.15 and body[at][0].isdigit():
                body[at] = str(rnd.randint(2, 9))
            elif rnd.random() < 0.1 and body[at] in names:
                body[at] = rnd.choice(names)
            elif rnd.random() < 0.01:
                body[at] = rnd.choice(words)
        text = " ".join(["lead in"] * rnd.randint(0, 2) + body + ["tail"])
        rows.append((d, rnd.choice([text, text, text, text.upper(), text.lower()])))
    want = brute_templates(rows, items)
    assert set(find(spark, make_docs, rows, items)) == want and 30 < len(want) < 1000


def test_windows_match_brute_force(spark, make_docs):
    """Without numbers and names, a hit is a run of 13 equal lower-case words."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeg") for _ in range(3))
    items = [(n, " ".join(word() for _ in range(30))) for n in range(12)]
    rows = []
    for d in range(60):
        words = [word() for _ in range(40)]
        src = rnd.choice(items)[1].split()
        n, at = rnd.randint(8, 20), rnd.randint(0, 10)
        words[5:5] = src[at : at + n]
        rows.append((d, " ".join(words)))
    runs = lambda t: {tuple(t.split()[k : k + 13]) for k in range(len(t.split()) - 12)}
    want = {(d, i): len(runs(t) & runs(x)) for d, t in rows for i, x in items if runs(t) & runs(x)}
    got = find(spark, make_docs, rows, items)
    assert {k: r["windows"] for k, r in got.items()} == want and len(want) > 20


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_large_benchmarks_take_the_shuffle_path(spark, make_docs, monkeypatch, bound):
    monkeypatch.setattr(D, "BROADCAST_ROWS", bound)
    assert set(find(spark, make_docs, [(1, ITEM), (2, "nothing of it")])) == {(1, 1)}


def test_contaminated_documents_go(spark, make_docs, awkward, nothing):
    bench = spark.createDataFrame([(1, ITEM, 0, 0)], ITEMS)
    docs = make_docs([(1, ITEM), (2, "clean text"), (3, None), (None, "also clean")])
    assert sorted(str(r["doc_id"]) for r in D.drop_contaminated(docs, bench).collect()) == ["2", "3", "None"]
    none = spark.createDataFrame([], ITEMS)
    assert D.drop_contaminated(awkward, bench).count() == 12 and D.drop_contaminated(awkward, none).count() == 12
    assert D.drop_contaminated(nothing, bench).count() == 0 and D.drop_contaminated(docs, bench).columns == docs.columns


def test_a_contradiction_ends_a_stretch_only(spark, make_docs):
    """One edited number or name must not throw away the windows around it."""
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("bcdfglmnrtaeiou") for _ in range(6)) for _ in range(n))
    item = f"they paid 45 coins {words(40)} and 45 coins more {words(40)} for 3 and 5 boats {words(14)}"
    edited = item.replace("and 45 coins", "and 46 coins")
    same = item.replace("for 3 and 5", "for 4 and 4")
    new = item.replace("45", "71")
    got = find(spark, make_docs, [(1, edited), (2, same), (3, new), (4, item)], [(1, item)])
    n = len(item.split()) - D.WINDOW + 1
    assert got[4, 1]["windows"] == n and got[4, 1]["exact"]
    # the 3 windows with the first 45 are in another stretch than the 13 with the edited one
    assert got[1, 1]["windows"] == n - 3 and not got[1, 1]["exact"]
    # 15 windows hold the 3 or the 5; all others are equal word for word
    assert got[2, 1]["windows"] == n - 15 and got[2, 1]["exact"]
    assert got[3, 1]["windows"] == n and not got[3, 1]["exact"]


def test_longest_stretch_matches_brute_force():
    rnd = random.Random(4)
    for _ in range(500):
        windows = [{(rnd.choice("abc"), rnd.choice("abc")) for _ in range(rnd.randint(0, 2))} for _ in range(rnd.randint(0, 9))]
        exact = sum(all(a == b for a, b in w) for w in windows)
        sound = [w for w in windows if D.one_to_one(w)]
        runs = [sound[i:j] for i in range(len(sound)) for j in range(i + 1, len(sound) + 1)]
        want = max([len(r) for r in runs if D.one_to_one(set().union(*r))], default=0)
        most, slots, whole = D.longest(windows)
        assert most == max(want, exact) and whole == (exact >= want and exact > 0)
        assert slots in {len(set().union(*r)) for r in [*runs, [w for w in windows if all(a == b for a, b in w)]]} | {0}


def test_exact_copies_are_found_in_any_case(spark, make_docs):
    table = "Paris 12 Rome 14 Oslo 9 Kyiv 20 Lima 31 Bern 8 Riga 17 Cairo 22"
    short = "Make seven green bottles stand upon walls"
    items = [(1, ITEM), (2, table), (3, short)]
    rows = [(1, ITEM.upper()), (2, ITEM.lower()), (3, ITEM.title()), (4, f"so {table} it is"), (5, f"then {short} today"), (6, table.replace("1", "7"))]
    got = find(spark, make_docs, rows, items)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)} and all(r["exact"] for r in got.values())
    assert {got[d, 1]["windows"] for d in (1, 2, 3)} == {17}


def test_short_items_take_only_documents_that_hold_them_as_a_line(spark, make_docs):
    rows = [(1, "oh yes, he said"), (2, "is it?\nYes\nfine then"), (3, "so what is 17 plus 5 then"), (4, "Well. What is 17 plus 5? I know"), (5, "no"), (6, "seven green bottles stood upon the old garden walls, he said"), (None, None)]
    items = [(1, "Yes"), (2, "What is 17 plus 5?"), (3, "seven green bottles stood upon the old garden walls")]
    got = find(spark, make_docs, rows, items)
    assert {k: r["evident"] for k, r in got.items()} == {(1, 1): False, (2, 1): True, (3, 2): False, (4, 2): True, (6, 3): True}
    bench = spark.createDataFrame([(i, t, 0, 0) for i, t in items], ITEMS)
    assert {r.doc_id for r in D.drop_contaminated(make_docs(rows), bench).collect()} == {1, 3, 5, None}
