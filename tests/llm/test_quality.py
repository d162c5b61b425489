import math
import random
import re
from collections import Counter

from millrace.llm.quality import quality_verdicts, thresholds

from .edge import awkward, documents, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_base_counts(spark, sf_dir):
    rng = random.Random(2)
    rows = awkward() + [(500 + i, "\n".join(rng.choice(("a b c d e f g h i", "x # y", "", " ", prose(rng, 12))) for _ in range(12))) for i in range(40)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = quality_verdicts(documents(spark, rows))
    assert "Python" not in got._jdf.queryExecution().toString()
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()}
    assert found == {(i, *brute(t)) for i, t in rows}
    assert got.count() == len(rows)


def test_odd_documents_of_a_group_go_and_clean_ones_stay(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60, 5000), "en", "web") for i in range(300)] + [(1000 + i, prose(rng, 60, 5000), "de", None) for i in range(5)]
    rows += [(2000, prose(rng, 40, 5000) + " ### $$$ *** |||| <<<>>> " * 3, "en", "web")]
    kept = {r.doc_id: r.kept for r in quality_verdicts(documents(spark, rows)).collect()}
    assert not kept[2000] and sum(kept[i] for i in range(300)) >= 297 and all(kept[1000 + i] for i in range(5))


def test_empty_table(spark):
    assert quality_verdicts(documents(spark, [])).count() == 0


def test_the_verdict_does_not_depend_on_partitions(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = [sorted((r.doc_id, r.kept) for r in quality_verdicts(table.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_quantiles_are_right_to_a_hundredth(spark):
    rng = random.Random(6)
    values = [rng.lognormvariate(0, 2) for _ in range(500)]
    frame = spark.createDataFrame([("en", "web", x, x, x, x) for x in values], "lang string, source string, symbol_ratio double, dup_line_ratio double, repeat_ratio double, mean_word double")
    row = thresholds(frame, weight=0.0).first()
    q = lambda p: sorted(values)[math.ceil(p * len(values)) - 1]
    low, high = q(0.5) - 6 * max(q(0.5) - q(0.05), 0.25), q(0.5) + 6 * max(q(0.95) - q(0.5), 0.25)
    assert abs(row.mean_word_high - high) < 0.01 * (q(0.5) + 6 * (q(0.95) + q(0.5))) and abs(row.mean_word_low - low) < 0.01 * (q(0.5) + 12 * q(0.5))
