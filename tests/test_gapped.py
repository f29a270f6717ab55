"""Places with gaps against edit distances by brute force."""

import random
import re

import pytest

from kinweave.operators import chunks, gapped, locate
from kinweave.operators import regions as R

from .test_find import rc


def least(q, text):
    """The least edits of q against a text that ends at each position."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(q, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return row


def edited(draw, q, n):
    q = list(q)
    for _ in range(n):
        at = draw.randrange(len(q))
        what = draw.choice("sid")
        if what == "s":
            q[at] = draw.choice("ACGT")
        elif what == "i":
            q.insert(at, draw.choice("ACGT"))
        else:
            del q[at]
    return "".join(q)


def spent(cigar):
    """Characters of the element, of the text, and edits of a CIGAR."""
    parts = [(int(n), op) for n, op in re.findall(r"(\d+)([=XID])", cigar)]
    return tuple(sum(n for n, op in parts if op in of) for of in ("=XI", "=XD", "XID"))


def check(found, elements, texts, most):
    expected = {}
    for i, q in elements.items():
        for strand, s in {q: "+"}.items() | ({rc(q): "-"}.items() if rc(q) != q else set()):
            for c, t in texts.items():
                ends = [(e, d) for e, d in enumerate(least(strand, t)) if d <= most]
                runs = []
                for e, d in ends:
                    if runs and runs[-1][-1][0] == e - 1:
                        runs[-1].append((e, d))
                    else:
                        runs.append([(e, d)])
                for run in runs:
                    e, d = min(run, key=lambda x: (x[1], x[0]))
                    expected[(i, c, e, s)] = d
    assert {(r["id"], r["contig"], r["end"], r["strand"]): r["edits"] for r in found} == expected
    for r in found:  # the CIGAR turns the one text into the other
        q = elements[r["id"]] if r["strand"] == "+" else rc(elements[r["id"]])
        t = texts[r["contig"]][r["start"] : r["end"]]
        assert spent(r["cigar"]) == (len(q), len(t), r["edits"])
        i = j = 0
        for n, op in re.findall(r"(\d+)([=XID])", r["cigar"]):
            for _ in range(int(n)):
                if op in "=X":
                    assert (q[i] == t[j]) == (op == "=")
                i, j = i + (op != "D"), j + (op != "I")
    return expected


@pytest.mark.parametrize("seed,most", [(1, 0), (2, 1), (3, 3), (4, 4)])
def test_gapped_places(spark, monkeypatch, seed, most):
    draw = random.Random(seed)
    base = "".join(draw.choices("ACGT", k=700))
    elements = {f"e{n}": base[a : a + draw.choice([40, 47, 60])] for n in range(6) for a in [draw.randrange(600)]}
    elements["ends"], elements["palindrome"], elements["repeat"] = base[:40], base[100:122] + rc(base[100:122]), "AC" * 22
    texts = {"a": base, "b": "".join(edited(draw, draw.choice([q, rc(q)]), draw.randrange(most + 2)) + "".join(draw.choices("ACGT", k=9)) for q in elements.values()), "c": "AC" * 60, "d": base[3:41], "e": ""}
    rows = spark.createDataFrame([("g", c, t) for c, t in texts.items()] + [("g", "n", None)], "genome string, contig string, seq string")
    given = spark.createDataFrame(list(elements.items()), "id string, seq string")
    found = gapped.locate_gapped(given, rows, most, 8).collect()
    expected = check(found, elements, texts, most)
    assert len(expected) > 10 and (most == 0 or any("I" in r["cigar"] for r in found) and any("D" in r["cigar"] for r in found) or most == 1)
    for module in (locate, chunks, R):
        monkeypatch.setattr(module, "CHUNK", 128)
    again = gapped.locate_gapped(given, chunks.chunked(rows, 128), most, 8)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found))


def test_elements_of_any_length(spark):
    draw = random.Random(8)
    text = "".join(draw.choices("ACGT", k=300))
    elements = {"long": text[10:130], "mid": text[150:171], "short": text[200:209], "least": "ACG"}
    rows = spark.createDataFrame([("g", "c", text)], "genome string, contig string, seq string")
    given = spark.createDataFrame([*elements.items(), ("none", None)], "id string, seq string")
    check(gapped.locate_gapped_all(given, rows, 2, 24).collect(), elements, {"c": text}, 2)
    with pytest.raises(ValueError):
        gapped.locate_gapped_all(given, rows, 3, 24)


def test_without_places(spark):
    rows = spark.createDataFrame([("g", "c", "ACGT" * 9)], "genome string, contig string, seq string")
    none = spark.createDataFrame([("x", None), ("y", "G" * 40)], "id string, seq string")
    assert gapped.locate_gapped(none, rows, 2, 8).count() == 0
    assert gapped.locate_gapped(none.where("false"), rows, 2, 8).count() == 0
    with pytest.raises(ValueError):
        gapped.locate_gapped(none, rows, 9, 8)
