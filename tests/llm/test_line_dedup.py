import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=16), st.text("abc", max_size=16), st.integers(1, 3))
def test_banded_distance(a, b, most):
    assert L.distance_within(a, b, most) == min(distance(a, b), most + 1)


def test_a_segment_survives():
    rnd = random.Random(3)
    for _ in range(2000):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randint(6, 30)))
        b = list(a)
        for _ in range(2):
            at = rnd.randrange(len(b))
            rnd.choice([lambda: b.pop(at), lambda: b.insert(at, rnd.choice("abcd")), lambda: b.__setitem__(at, rnd.choice("abcd"))])()
        x, y = sorted((a, "".join(b)), key=len, reverse=True)
        parts = L.cuts(len(y), 2)
        assert any(x[p : p + n] == y[parts[k][0] : parts[k][0] + n] for k, p, n in L.spots(len(x), len(y), 2))


def brute(rows, edits=L.EDITS):
    """Class of every line, and whether it has a link, by comparing all different lines."""
    lines = {}
    for d, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.strip():
                lines.setdefault(line, []).append((d, n))
    names, root = list(lines), {x: x for x in lines}
    links = dict.fromkeys(lines, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            most = L.allowed(min(len(a), len(b)), edits)
            if abs(len(a) - len(b)) <= most and L.distance_within(a, b, most) <= most:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first = {}
    for x, places in lines.items():
        first[find(x)] = min(first.get(find(x), places[0]), *places)
    return sorted((d, n, *first[find(x)], links[x] > 0) for x, places in lines.items() for d, n in places)


def corpus(seed):
    rnd = random.Random(seed)
    base = [" ".join("".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(3, 9))) for _ in range(25)]
    rows = []
    for d in range(40):
        out = []
        for _ in range(rnd.randint(0, 6)):
            line = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(line))
                rnd.choice([lambda: line.pop(at), lambda: line.insert(at, "q"), lambda: line.__setitem__(at, "z")])()
            out.append("".join(line))
        rows.append((d, "\n".join(out)))
    return rows


def test_classes_match_brute_force(make_docs):
    rows = corpus(5)
    got = sorted(tuple(r) for r in L.line_classes(make_docs(rows)).collect())
    assert got == brute(rows)
    assert sum(r[4] for r in got) > 20


def test_many_candidates_take_the_shuffle_path(make_docs, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    rows = corpus(6)
    assert sorted(tuple(r) for r in L.line_classes(make_docs(rows)).collect()) == brute(rows)


def templates(n, seed=7):
    """Variants of one line: numbers of four and of eight digits, a dense ball of single edits, a sparse one of two edits, with and without its middle."""
    rnd = random.Random(seed)
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge and then sleeps until the morning comes again"
    lines = [f"order {k:04d} was shipped from the central warehouse on time" for k in rnd.sample(range(10_000), n)]
    lines += [f"{rnd.randrange(10**8):08d} is the number that the clerk wrote into the big ledger" for _ in range(n)]
    lines += [f"item {k} of the list is ready for the next step of the work" for k in rnd.sample(range(5, 3 * n), n)]
    for edits in (1, 2):
        for _ in range(n):
            line = list(base[edits:])
            for at in rnd.sample(range(len(line)), edits):
                line[at] = rnd.choice("0123456789")
            lines.append("".join(line))
    lines += [base[2:], "tiny 1", "tiny 2", "a short line 1", "a short line 2", "a short lime 3"]
    rnd.shuffle(lines)
    return [(d, line) for d, line in enumerate(lines)]


@pytest.mark.parametrize("n", [60, 110])
def test_heavy_groups_match_brute_force(make_docs, n):
    rows = templates(n)
    got = sorted(tuple(r) for r in L.line_classes(make_docs(rows)).collect())
    assert got == brute(rows)
    # short lines link in proportion to their length
    place = {text: d for d, text in rows}
    of = {r[0]: r[2] for r in got}
    assert of[place["tiny 1"]] != of[place["tiny 2"]] and of[place["a short line 1"]] == of[place["a short line 2"]] != of[place["a short lime 3"]]


def test_rows_grow_with_the_group_not_its_square(make_docs, monkeypatch):
    """Rows of every step for 200, 400 and 800 variants of a line."""
    made, kept = {}, L.materialise

    def counting(df, tag):
        out = kept(df, tag)
        made[tag] = made.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(L, "materialise", counting)
    rnd = random.Random(2)
    names, sizes = rnd.sample(range(10_000), 800), []
    for n in (200, 400, 800):
        made.clear()
        rows = [(d, f"order {k:04d} was shipped from the central warehouse on time") for d, k in enumerate(names[:n])]
        assert len({r["class_doc"] for r in L.line_classes(make_docs(rows)).collect()}) == 1
        sizes.append(made["lines-candidates"] + made.get("lines-state", 0) + made["lines-met"])
    assert all(size < 300 * n for size, n in zip(sizes, (200, 400, 800), strict=True))


def test_dedup_keeps_the_first_of_each_class(make_docs):
    line, near = "a line that is long enough to count", "a line that is long enough to counts"
    docs = make_docs([(1, f"{line}\nshort\n\nown text of the first document"), (2, f"{near}\nshort\nown text of the second document"), (3, line), (4, None)])
    got = {r["doc_id"]: r for r in L.dedup(docs).collect()}
    assert got[1]["text"] == f"{line}\nshort\n\nown text of the first document" and got[2]["text"] == "own text of the second document" and got[3]["text"] == "" and got[4]["text"] is None
    assert got[2]["n_chars"] == len(got[2]["text"]) and got[1].asDict().keys() == docs.first().asDict().keys()


def test_awkward_rows(awkward, nothing):
    assert L.dedup(awkward).count() == 12 and L.dedup(nothing).count() == 0 and L.line_classes(nothing).count() == 0
    lines = [tuple(r) for r in L.line_classes(awkward).collect()]
    assert sum(d == 2 for d, *_ in lines) == 2 and sum(d in (3, 4, 5) for d, *_ in lines if d is not None) == 0
