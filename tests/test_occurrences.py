"""Occurrences and coverage, and the whole inference, against plain versions."""

import random

import pytest

from massq.operators import inference, occurrences


def plain_cover(sequence, peptides):
    fold = lambda s: s.replace("I", "L")
    s, hit = fold(sequence), set()
    for p in map(fold, peptides):
        hit |= {i + k for i in range(len(s) - len(p) + 1) if p and s[i : i + len(p)] == p for k in range(len(p))}
    return len(hit)


def test_spans_overlap_and_nest():
    starts, ends, names = occurrences.spans("AAAABA", ["AA", "AAB", "A", "", "X"])
    assert sorted(zip(starts.tolist(), ends.tolist(), names, strict=True)) == sorted([(0, 2, "AA"), (1, 3, "AA"), (2, 4, "AA"), (2, 5, "AAB"), *((k, k + 1, "A") for k in (0, 1, 2, 3, 5))])
    assert occurrences.union_length(starts, ends, 6) == 6 and len(occurrences.spans("ABC", [])[0]) == 0


def test_coverage_against_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(str(k), "".join(rng.choice("AILK") for _ in range(rng.randint(0, 60))), ["".join(rng.choice("AILK") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 6))]) for k in range(80)]
    rows += [("none", None, ["A"]), ("nothing", "AAA", None), ("empty", "", ["A"])]
    frame = spark.createDataFrame(rows, "accession string, sequence string, peptides array<string>").repartition(3)
    got = {r.accession: (r.covered, r.length) for r in occurrences.coverage(frame).collect()}
    assert got == {k: (plain_cover(s, p or []), len(s)) for k, s, p in rows if s is not None}
    places = {(r.accession, r.peptide, r.start, r.end) for r in occurrences.occurrences(frame).collect()}
    want = set()
    for k, s, ps in rows:
        for p in {x.replace("I", "L") for x in ps or []} if s else ():
            want |= {(k, p, i, i + len(p)) for i in range(len(s)) if s.replace("I", "L")[i : i + len(p)] == p}
    assert places == want


def test_a_long_sequence_is_linear(spark):
    """A sequence of a million letters under a thousand peptides, many times over."""
    rng = random.Random(1)
    text = "".join(rng.choice("ACDEFGHKLMNPQRSTVWY") for _ in range(1_000_000))
    peptides = [text[i : i + 20] for i in range(0, 1_000_000, 1000)]
    got = occurrences.coverage(spark.createDataFrame([("x", text, peptides)], "accession string, sequence string, peptides array<string>")).first()
    assert (got.covered, got.length) == (20_000, 1_000_000)


def plain_inference(psms, sequences, q=0.01):
    """Groups as they come out of the whole inference: {leader: (members, peptides, unique, razor, score, coverage)}."""
    of, score = {}, {}
    for peptide, accessions, s, value in psms:
        if value is None or value <= q:
            for a in accessions:
                of.setdefault(a, set()).add(peptide.replace("I", "L"))
                score[a] = max(s, score.get(a, s))
    groups = {}
    for a, ps in of.items():
        groups.setdefault(frozenset(ps), []).append(a)
    rows = [{"peptides": ps, "members": sorted(m), "first": min(m), "score": max(score[a] for a in m)} for ps, m in groups.items()]
    kept, gained = [], {}
    for g in rows:
        above = [h for h in rows if g["peptides"] < h["peptides"]]
        if above:
            gained.setdefault(min(above, key=lambda h: (-len(h["peptides"]), h["first"]))["first"], []).extend(g["members"])
        else:
            kept.append(g)
    kept = [g | {"members": sorted(set(g["members"] + gained.get(g["first"], [])))} for g in kept]
    left, chosen = set().union(*[g["peptides"] for g in kept]) if kept else set(), []
    while left:
        best = min((g for g in kept if g["peptides"] & left), key=lambda g: (-len(g["peptides"] & left), -g["score"], g["first"]))
        chosen.append(best)
        left -= best["peptides"]
    holders = {}
    for g in chosen:
        for p in g["peptides"]:
            holders.setdefault(p, []).append(g)
    unique = {g["first"]: {p for p in g["peptides"] if len(holders[p]) == 1} for g in chosen}
    razor = {p: min(hs, key=lambda g: (-len(unique[g["first"]]), -g["score"], g["members"][0]))["first"] for p, hs in holders.items() if len(hs) > 1}
    out = {}
    for g in chosen:
        leader, mine = g["members"][0], {p for p, f in razor.items() if f == g["first"]}
        s = sequences.get(leader)
        out[leader] = (g["members"], sorted(g["peptides"]), sorted(unique[g["first"]]), sorted(mine), g["score"], plain_cover(s, g["peptides"] | mine) / len(s) if s else None)
    return out


@pytest.mark.parametrize(("seed", "local"), [(1, None), (2, None), (3, 0), (4, 0)])
def test_the_whole_inference_against_a_plain_version(spark, seed, local, monkeypatch):
    rng = random.Random(seed)
    peptides = ["".join(rng.choice("ACDEFGHIL") for _ in range(rng.randint(4, 7))) + "K" for _ in range(40)]
    sequences = {f"P{k:02}": "".join(rng.sample(peptides, rng.randint(1, 8))) for k in range(25)}
    sequences["P90"], sequences["P91"] = sequences["P03"], ""
    psms = []
    for p in peptides:
        holders = [a for a, s in sequences.items() if p in s]
        if holders:
            psms += [(p, holders, float(rng.randint(1, 9)), rng.choice([0.001, 0.005, None, 0.5])) for _ in range(2)]
    if local is not None:
        monkeypatch.setattr(inference.parsimonious, "__defaults__", (local,))
    found = inference.infer(spark.createDataFrame(psms, "peptide string, accessions array<string>, score double, q_value double"), spark.createDataFrame(list(sequences.items()), "accession string, sequence string"))
    got = {r.leader: (r.members, r.peptides, r.unique_peptides, r.razor_peptides, r.score, r.coverage) for r in found.collect()}
    want = plain_inference(psms, sequences)
    assert len(want) > 5 and got == want
