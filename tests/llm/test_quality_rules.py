import random
import re
from collections import Counter

from peltrane.llm import quality_rules as q

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rules"]


def measures(text):
    """The contract's measures, and which rules a text fails."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols, again = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    short, repeats = len(w) < 50, 100 * len(hit) > 50 * len(w)
    rules = {"short": short, "repeats": repeats, "symbols": 10 * symbols > len(w), "lines": 10 * again > 3 * len(lines), "word_length": not 3 * len(w) <= chars <= 10 * len(w)}
    return (len(w), chars, symbols, again, len(hit), short or repeats), rules


def verdicts(rows, tail=q.TAIL, least_rate=q.LEAST_RATE):
    given = [(k, *measures(t), h) for k, t, h in rows]
    said = {x[-1]: [] for x in given}
    for rule in ("short", "repeats", "symbols", "lines", "word_length"):
        failed, n = Counter(), Counter()
        for *_, rules, host in given:
            n[host] += 1
            failed[host] += rules[rule]
        rates = [failed[h] / n[h] for h in n]
        mean = sum(rates) / len(rates)
        variance = sum((x - mean) ** 2 for x in rates) / len(rates)
        strength = max(4.0, min(1000.0, mean * (1 - mean) / variance - 1)) if variance > 0 else 1000.0
        limit = max(least_rate, mean + tail * (mean * (1 - mean) / (strength + 1)) ** 0.5)
        for h in n:
            if (failed[h] + mean * strength) / (n[h] + strength) > limit:
                said[h].append(rule)
    return [(k, *m, not m[-1] and not said[h], ",".join(said[h])) for k, m, _, h in given]


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    for options in ({}, {"tail": 0.5, "least_rate": 0.0}):
        out = q.quality_verdicts(awkward, **options).select(COLUMNS).collect()
        assert sorted(map(tuple, out), key=repr) == sorted(verdicts(rows, **options), key=repr)


def test_bad_hosts_are_rejected_by_the_rule_they_fail(spark):
    """Hosts that differ: one of short texts, one of symbols (no base rule), one of long words, forty ordinary ones."""
    rng = random.Random(6)
    good = lambda: " ".join(f"w{rng.randrange(1 << 16)}" for _ in range(60))
    rows = [(i, "short" if i < 95 else good(), "thin") for i in range(100)]
    rows += [(100 + i, " ".join(f"w{rng.randrange(1 << 16)} #" for _ in range(60)) if i % 10 else good(), "tags") for i in range(100)]
    rows += [(200 + i, " ".join("x" * rng.randrange(15, 40) for _ in range(60)), "hex") for i in range(50)]
    rows += [(300 + i, good() if i % 12 else "short", f"h{i % 40}") for i in range(800)]
    rows += [(2000, good() + " #" * 30, None)]  # one odd text of a small host is no verdict on it
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [tuple(r) for r in q.quality_verdicts(docs).select(COLUMNS).collect()]
    want = verdicts(rows)
    assert sorted(out) == sorted(want)
    hosts = {h: x[-1] for x, (_, _, h) in zip(want, rows, strict=True)}
    assert hosts["thin"] == "short" and hosts["tags"] == "symbols" and hosts["hex"] == "word_length" and hosts["h1"] == hosts[None] == ""
    assert {r.doc_id for r in q.quality_filter(docs).collect()} == {x[0] for x in want if x[7]} == {300 + i for i in range(800) if i % 12} | {2000}


def test_filter_hands_all_columns_through(awkward):
    out = q.quality_filter(awkward)
    assert out.columns == awkward.columns
    kept = sorted((x[0] for x in verdicts([(r.doc_id, r.text, r.source) for r in awkward.collect()]) if x[7]), key=repr)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == kept


def test_empty(empty):
    assert q.quality_verdicts(empty).count() == 0
