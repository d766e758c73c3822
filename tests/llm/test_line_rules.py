import re
from collections import Counter, defaultdict

from siftwell.llm import line_rules as L

BLANK = "\x20\x09-\x0d"


def base(text):
    text = text or ""
    w = re.findall(f"[^{BLANK}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{BLANK}]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def norm(line):
    return line.strip(" \t\n\x0b\f\r").lower()


def often(rows, floor, share):
    hold, size = defaultdict(set), defaultdict(set)
    for i, text, host in rows:
        doc = ("text", text) if i is None else i
        size[host].add(doc)
        for x in (text or "").split("\n"):
            if norm(x):
                hold[host, norm(x)].add(doc)
    return {k for k, v in hold.items() if len(v) > max(floor, share * len(size[k[0]]))}


def brute(rows, floor, share):
    gone_lines, out = often(rows, floor, share), []
    for i, text, host in rows:
        n, *rest = base(text)
        gone = sum(len(re.findall(f"[^{BLANK}]+", x)) for x in (text or "").split("\n") if (host, norm(x)) in gone_lines)
        failed = n < 10 or 100 * rest[3] > 20 * n
        out.append((i, n, *rest, failed, gone, not failed and not (gone and (n - gone < L.LEAST_WORDS or n - gone < L.LEAST_SHARE * n))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    rows = [(i, f"{body(i)}\nShared  line of five words\n", "h1") for i in range(4)]
    rows += [(10 + i, f"Shared boilerplate that everybody has on this host and nothing else at all\nown{i}", "h2") for i in range(5)]
    rows += [(20, None, None), (21, "", "h1"), (22, " \t\n\n", "h1"), (23, "a b c d e f " * 4, "h1"), (24, "x\ny\nx\n x\nX", None), (25, "é ü | <b> 100% $5 #1 *a* & co naïve", "h1"), (25, "é ü | <b> 100% $5 #1 *a* & co naïve", "h1"), (None, body(99), "h2"), (26, "w " * 30_000, "h1")]
    rows += [(30 + i, rows[4][1], "h3") for i in range(6)]
    # one line three times without a host, three times with an empty one: no more than three of either; one id four times
    rows += [(40 + i, f"{body(40 + i)}\nA line on no host", ("", None)[i % 2]) for i in range(6)] + [(50, f"{body(50)}\nMany rows of one id", "h4")] * 4
    rows += [(60 + i, f"{body(i)}\nOn a large host", "h5") for i in range(4)] + [(70 + i, body(i), "h5") for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, kept string").repartition(3)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
    for share in (0.0, 0.2):
        want = brute(rows, 3, share)
        assert sorted((tuple(r[n] for n in names) for r in L.judged(df, floor=3, share=share).collect()), key=str) == want
        assert any(r[7] for r in want) and any(r[8] != (not r[6]) for r in want)
    assert L.judged(df.limit(0)).collect() == []
    gone = often(rows, 3, 0.0)
    left = [(i, t if t is None else "\n".join(x for x in t.split("\n") if (h, norm(x)) not in gone), h, 1, "x") for i, t, h in rows]
    assert sorted(map(tuple, L.cleaned(df, floor=3, share=0.0).collect()), key=str) == sorted(left, key=str)


def test_plan_is_native(spark, sf):
    plan = L.op9_line_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
