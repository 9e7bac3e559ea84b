import random

from stanceframe.llm import line_dedup

from . import data
from .test_links import roots


def sets(line, width=8):
    line = line_dedup.normal(line)
    return frozenset(line[i : i + width] for i in range(max(1, len(line) - width + 1)))


def test_lines_are_those_of_brute_force(spark):
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    lines = [" ".join(rnd.choices(words, k=25)) for _ in range(12)]

    def near(line):
        w = line.split(" ")
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        return " ".join(w)

    docs = [(i, "\n".join([near(rnd.choice(lines)), "", "  ", rnd.choice(["Short", "short ", "other", lines[3].upper()]), near(lines[i % 12])])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, lines[0])]
    found = [(i, n, line) for i, t in docs for n, line in enumerate((t or "").split("\n")) if line.strip()]
    edges, all_sets = [], [sets(x[2]) for x in found]
    for a in range(len(found)):
        for b in range(a):
            both = len(all_sets[a] & all_sets[b])
            if 100 * both >= 80 * len(all_sets[a] | all_sets[b]):
                edges.append((a, b))
    root = roots(range(len(found)), edges)
    best = {}
    for k, r in root.items():
        order = (found[k][0] is None, found[k][0] or 0, found[k][1])
        best[r] = min(best.get(r, (order, k)), (order, k))
    dropped = {i: [] for i, _ in docs}
    for k, r in root.items():
        if best[r][1] != k:
            dropped[found[k][0]].append(found[k][1])
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    assert {r.doc_id: (r.n_dropped, r.dropped) for r in got.collect()} == {i: (len(d), sorted(d)) for i, d in dropped.items()}


def test_odd_rows(spark):
    got = line_dedup.dedup_lines(data.docs(spark)).collect()
    assert len(got) == len(data.rows())
    assert sum(r.n_lines for r in got) == sum(bool(x.strip()) for r in data.rows() for x in (r[1] or "").split("\n"))
    assert line_dedup.dedup_lines(data.empty(spark)).count() == 0
    assert line_dedup.without_lines("a\nb\nc", [1]) == "a\nc"


def test_repeated_rows_and_long_lines(spark):
    long = " ".join(f"w{i * i}" for i in range(40_000))
    docs = [(1, "first line of the text\nsecond one"), (1, "first line of the text\nsecond one"), (2, long), (3, long + " end"), (3, "\n \n"), (None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    assert sorted((r.doc_id or 0, r.n_lines, r.dropped) for r in got.collect()) == [(0, 0, []), (1, 2, []), (1, 2, [0, 1]), (2, 1, []), (3, 0, []), (3, 1, [0])]


def test_similar_pairs_are_those_of_sets():
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abcd ", k=rnd.randint(1, 60))).strip() or "a" for _ in range(60)]
    pairs = [(a, a[: rnd.randint(1, len(a))] + rnd.choice(base)[:3]) for a in base] + [(a, a) for a in base]
    want = [100 * len(sets(a) & sets(b)) >= 80 * len(sets(a) | sets(b)) for a, b in pairs]
    got = line_dedup.similar([(line_dedup.normal(a), line_dedup.normal(b)) for a, b in pairs])
    assert got == want and line_dedup.similar([]) == []


def test_lines_alone_are_not_joined(spark, monkeypatch):
    """Only lines that share their place with others are shuffled; equal lines of different tasks are among these."""
    counts, old = {}, line_dedup.materialize

    def counted(df, label, **options):
        out = old(df, label, **options)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    docs = [(i, f"{i * i * 7919} is a line of its own {i}{i}{i}\n{'one line that each of the documents has' if i % 2 else ''}") for i in range(200)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_lines, r.dropped) for r in got} == {i: (1 + i % 2, [1] if i % 2 and i > 1 else []) for i in range(200)}
    assert counts["lines"] == 300 and 100 <= counts["placed"] < 200
