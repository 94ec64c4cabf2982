"""Groups carry a number for their digest through the shuffles of schools, and their rows are dealt by it once."""

import random
import re

from pyspark.sql import functions as F

from reprise.operators import groups, skew

ROWS = "sha256 string, cluster string, inep long, fornecedor string"


def names_of(field):
    if field is None:
        return set()
    parts = field.split("/") if "(RI)" in field or "(RE)" in field else [field]
    return {n for n in (p.replace("(RI)", "").replace("(RE)", "").strip() for p in parts) if n}


def expected(rows, key):
    """(schools, occurrences, digests, common names) of each cluster that crosses schools."""
    out = {}
    for c in {r[key] for r in rows} - {None}:
        own = [r for r in rows if r[key] == c]
        schools = {}
        for _, _, inep, field in own:
            if inep:
                schools.setdefault(inep, set()).update(names_of(field))
        if len(schools) > 1:
            out[c] = (len(schools), len(own), len({r[0] for r in own}), " / ".join(sorted(set.intersection(*schools.values()))))
    return out


def made():
    rng = random.Random(3)
    fields = ["A", "B", "A (RI) / B (RE)", "A (RI) / A (RE)", "B (RI) / C", "C/A", " ", None, "D (RE)"]
    return [(f"{i % 40:064x}" if i % 50 else None, f"g{i % 13}" if i % 31 else None, rng.choice([None, 0, 1, 2, 3]), rng.choice(fields[:rng.choice([2, 3, 9])]))
            for i in range(900)] + [("f" * 64, "h", s, f) for s, f in [(7, "A"), (7, "B"), (8, "A (RI) / B (RE)"), (8, "A"), (9, "B"), (9, "A"), (None, "Z")]]


def got(df):
    return {r["cluster"]: (r.qtd_ineps, r.qtd_ocorrencias, r.qtd_shas, r.fornecedor) for r in df.collect()}


def test_groups_against_brute_force(spark):
    rows = made()
    occ = spark.createDataFrame(rows, ROWS)
    for key, at in (("sha256", 0), ("cluster", 1)):
        want = expected([(r[0], r[1], r[2], r[3]) for r in rows], at)
        if key == "cluster":
            want = {c: (a, b, len({r[0] for r in rows if r[1] == c and r[0] is not None}), n) for c, (a, b, _, n) in want.items()}
        assert got(groups.group_summary(occ, key, same_supplier=False, ignore_templates=False)) == want
        assert got(groups.group_summary(occ, key)) == {c: w for c, w in want.items() if w[3]}
        assert {r[key] for r in groups.template_clusters(occ, key).collect()} == {c for c, w in want.items() if not w[3]}
    assert expected(rows, 0)["f" * 64][3] == "A / B"


def test_digests_that_share_a_hash_stay_apart(spark, monkeypatch):
    real, seeds = skew.hashed, []

    def few(seed, key):
        seeds.append(seed)
        return real(seed, key) if seed > 1 else F.pmod(real(seed, key), F.lit(3))

    monkeypatch.setattr(skew, "hashed", few)
    rows = made()
    assert got(groups.group_summary(spark.createDataFrame(rows, ROWS), same_supplier=False, ignore_templates=False)) == expected(rows, 0)
    assert seeds == [0, 1, 2]


def test_rows_of_schools_are_shuffled_twice_without_their_digest(spark, monkeypatch):
    plans, real = [], groups.materialise
    monkeypatch.setattr(groups, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    groups.group_summary(spark.createDataFrame(made(), ROWS))
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", "\n".join(plans))
    assert not [d for d in dealt if "sha256" in d and re.search("escola|fornecedor|nome", d)], dealt
    assert len([d for d in dealt if "sha256" not in d]) <= 3, dealt  # combined, dealt by cluster, and the digests that join them
