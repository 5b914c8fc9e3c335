from collections import Counter, defaultdict

from trailmark.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, target string, u int"


def rows():
    out = [(i, "w " * (5 + i * 7 % 40), f"s{i % 5}", "clash", 1) for i in range(1500)]
    out += [(2000 + i, "x y z", "big", "", 0) for i in range(1500)]
    out += [(5000, None, "s0", "", 0), (5001, "", "empty", "", 0), (5002, "one two", None, "", 0), (5003, "l " * 20000, "s1", "", 0), (None, "no id", "s2", "", 0), (3, "same id", "s3", "", 0), (4, "again", "s4", "", 0), (4, "again", "s4", "", 0)]
    return out


def test_targets_and_copies(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = M.pareto_mix(docs).collect()
    again = M.pareto_mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows())
    size, taken, target, most = Counter(), Counter(), {}, defaultdict(int)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
        assert 0 <= r.copies <= 2 and r.source_size >= r.size
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= most[s] / 2 + 1e-9 for s in size)
    # sources by code point, null last: big 5, empty 2, s0 1, s1 5, s2 2, s3 1, s4 5, null 2
    open_ = {s: target[s] / w for s, w in zip(["big", "empty", "s0", "s1", "s2", "s3", "s4", None], [5, 2, 1, 5, 2, 1, 5, 2]) if target[s] < 2 * size[s] - 1e-6}
    assert max(open_.values()) - min(open_.values()) < 1e-6


def test_documents_are_repeated_whole(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in M.pareto_mix(docs).collect():
        want[r.doc_id, r.size] += r.copies
    got = Counter((r.doc_id, len((r.text or "").split())) for r in mixed.collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_empty_table(spark):
    assert M.pareto_mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_documents_have_greater_odds_of_inclusion(spark):
    docs = spark.createDataFrame([(i, "w " * (3 if i % 2 else 900), f"s{i % 4 // 2}") for i in range(8000)], "doc_id long, text string, source string")
    copies = defaultdict(list)
    for r in M.pareto_mix(docs, weights=(1, 9)).collect():
        copies[r.source, r.size].append(r.copies)
    mean = {k: sum(v) / len(v) for k, v in copies.items()}
    # the measures are 2 and 10 binary digits: five times the copies, by chance to a few hundredths
    assert abs(mean["s0", 900] / mean["s0", 3] - 5) < 1 and mean["s1", 900] == 2


def test_reserved_names_and_repeated_rows_pass_through(spark):
    docs = spark.createDataFrame([(i // 2, "a b c", "s", 7, "x") for i in range(40)], "doc_id long, text string, source string, mix_copies int, copies string")
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("mix_copies <> 7 or copies <> 'x'").count() == 0
    assert mixed.count() == sum(r.copies for r in M.pareto_mix(docs).collect())
