from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import canonical

NAMES = {"refuse_cart": ["wheelie bin", "WHEELIE BIN"], "lp_gas_vessel": ["propane bottle"], "passenger_vehicle": ["sedan", "pickup truck"], "straw_bale": ["hay bale"], "rain_barrel": None}


@pytest.mark.parametrize(
    ("value", "name"),
    [("Wheelie Bin", "refuse_cart"), ("2 x wheeliebin?", "refuse_cart"), ("bin, wheelie", "refuse_cart"), ("lp-gas-vwssek", "lp_gas_vessel"),
     ("prooane bottlw next to door", "lp_gas_vessel"), ("PATRO1", canonical.UNMATCHED), ("sed.", "passenger_vehicle"), ("sédan (rusty) #3", "passenger_vehicle"),
     ("Hay\xa0Bales", "straw_bale"), ("STRAW ABLE", "straw_bale"), ("hammock", canonical.UNMATCHED), ("???", canonical.UNMATCHED), ("", canonical.UNMATCHED),
     ("a sedan near a pickup truck", "passenger_vehicle"), ("rain barre", "rain_barrel"), ("x" * 5000, canonical.UNMATCHED)],
)
def test_match(value, name):
    assert canonical.Matcher(NAMES).match(value)[0] == name


def test_distance():
    assert canonical.edit_distance("abcd", "abdc", 3) == 1
    assert canonical.edit_distance("abc", "abc", 0) == 0
    assert canonical.edit_distance("abc", "xyz", 2) == 3
    assert canonical.edit_distance("", "ab", 5) == 2
    assert canonical.edit_distance("ca", "abc", 5) == 2  # a swap around an insertion
    assert canonical.edit_distance("snagstpu", "snagstump", 2) == 2


def test_abbreviations_end_a_window():
    m = canonical.Matcher({"conifer_crown": [], "pine_needle_litter": ["conifer litter"]})
    assert m.match("2 x Conifer Cro.")[0] == "conifer_crown"
    assert m.match("conifer  LITT.")[0] == "pine_needle_litter"


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
def test_distance_against_plain_recursion(a, b):
    far = len(a) + len(b)
    d = {(i, j): far for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1)}
    last = dict.fromkeys("ab", 0)
    for i in range(len(a) + 1):
        d[i, 0] = i
    for j in range(len(b) + 1):
        d[0, j] = j
    for i in range(1, len(a) + 1):
        held = 0
        for j in range(1, len(b) + 1):
            k, l = last[b[j - 1]], held
            same = a[i - 1] == b[j - 1]
            held = j if same else held
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, l - 1] + (i - k - 1) + 1 + (j - l - 1) if k and l else far)
        last[a[i - 1]] = i
    assert canonical.edit_distance(a, b, 20) == d[len(a), len(b)]
    for most in (1, 2, 3):
        assert canonical.edit_distance(a, b, most) == d[len(a), len(b)] or (canonical.edit_distance(a, b, most) > most < d[len(a), len(b)])


def test_longest_mention_wins():
    m = canonical.Matcher({"hose": [], "garden_hose_reel": [], "gate": []})
    assert m.match("garden hose reel by the gate")[0] == "garden_hose_reel"


def test_held_out_typos(spark, sf):
    """Names with one random edit find their class; strangers do not."""
    names = canonical.reference_list(spark.read.parquet(f"{sf}/lab_taxonomy.parquet"))
    m, rng, right, n = canonical.Matcher(names), random.Random(4), 0, 0
    for name, aliases in names.items():
        for label in [name, *aliases]:
            text = list(label.replace("_", " ").upper() if rng.random() < 0.3 else label.replace("_", " "))
            text[rng.randrange(len(text))] = rng.choice("qxz")
            n, right = n + 1, right + (m.match("".join(text))[0] == name)
    assert right >= 0.97 * n
    assert all(m.match(w)[0] == canonical.UNMATCHED for w in ("basketball hoop", "satellite dish", "grazing cow", "n/a", "flagpole"))


def test_table(spark):
    rows = [(1, "refuse_cart", "old"), (2, "Wheelie  bin", None), (3, None, None), (4, " ", None), (5, "hammock", None)] + [(i, "sedan", None) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "id int, object_class string, canonical_class string")
    out = {r["id"]: (r["canonical_class"], r["found_by"]) for r in canonical.canonicalise(df, "object_class", NAMES).collect()}
    assert out[1] == ("refuse_cart", "exact") and out[2] == ("refuse_cart", "mention") and out[5] == ("UNMATCHED", "none")
    assert len(out) == 33 and 3 not in out and 4 not in out and out[20] == ("passenger_vehicle", "mention")
    assert canonical.canonicalise(df.limit(0), "object_class", NAMES).count() == 0
    assert {r["canonical_class"] for r in canonical.canonicalise(df, "object_class", {}).collect()} == {"UNMATCHED"}


def test_any_order_of_many_words_and_short_names():
    """Names of five words in every order, written as one, and names of two or three letters with a missing letter."""
    m = canonical.Matcher({"a_big_red_garden_hose": [], "lp_gas_vessel": ["lp cylinder"], "pv_rack": []})
    words = "a big red garden hose".split()
    rng = random.Random(1)
    for _ in range(30):
        rng.shuffle(words)
        assert m.match(" ".join(words))[0] == m.match("".join(words))[0] == "a_big_red_garden_hose"
    assert m.match("l cylinder")[0] == "lp_gas_vessel" and m.match("rack pv")[0] == "pv_rack"


def test_blocks_give_what_one_list_gives(spark, sf, monkeypatch):
    """A list of many blocks against the whole list in one."""
    taxonomy = spark.read.parquet(f"{sf}/lab_taxonomy.parquet")
    whole = canonical.reference_list(taxonomy)
    values = ["garden gate", "Cargo Traaileer", "hammock", "sed.", "wheliebin", "oak canopy next to pine crown", "tree, frui", "refuse_cart", "porch teps", "xyz", None]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    one = {r["value"]: tuple(r)[1:3] for r in canonical.match_values(df, whole).collect()}
    monkeypatch.setattr(canonical, "MAX_NAMES", 25)
    blocks = canonical.reference_blocks(taxonomy)
    assert len(blocks) > 4 and {k: v for b in blocks for k, v in b.items()} == whole
    assert {r["value"]: tuple(r)[1:3] for r in canonical.match_values(df, blocks).collect()} == one and len(one) == 10
    assert one["refuse_cart"] == ("refuse_cart", "exact") and one["xyz"] == ("UNMATCHED", "none")
