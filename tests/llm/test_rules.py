import re
from collections import Counter

from conftest_llm import words

from massq.llm import rules


def counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(docs, rows):
    got = rules.judge(docs.select("doc_id", "text", "size")).collect()
    by_text = {x.text: x for x in got}
    assert len(got) == len(rows)
    for r in rows:
        x, want = by_text[r[1]], counts(r[1])
        assert (x._q_n_words, x._q_word_chars, x._q_n_symbols, x._q_n_dup_lines, x._q_n_repeat_words) == want
        assert x._verdict.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (x._verdict.base_failed and x._verdict.kept)


def test_table_is_compiled(docs):
    strict = (*rules.THRESHOLDS, ("symbol_ratio", 1.0, None))
    assert rules.judge(docs, strict).where("_verdict.kept").count() == 0
    assert "symbol_ratio" in rules.judge(docs, strict).first()._verdict.failed


def test_no_user_function_and_no_shuffle(docs):
    plan = rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty(none):
    assert rules.judge(none).count() == 0
