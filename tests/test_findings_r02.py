"""What a round's findings showed: rows that differed from SQL, and work that grew too much."""

import duckdb
import pytest

import __spark_entry__ as entry

QUERY_TEXTS = {
    # a four-word run gives a later three's letters
    1: "oureen le que de x y oureen leque de",
    2: "th th th th th th thth thth thth a b c",
}


@pytest.fixture
def folder(spark, tmp_path):
    def make(texts):
        spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def check(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    df, want = entry.queries()[name](spark, folder), con.sql(entry.oracle_sql()[name])
    got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
    return got


@pytest.mark.parametrize("name", ["align_exact", "align_exact_norm", "align_multiline"])
def test_aligned_runs_have_as_many_words_as_in_sql(spark, folder, name):
    assert check(spark, folder(QUERY_TEXTS), name)


def test_codes_begin_as_printed(spark, folder):
    """A sharp s is two letters only in capitals, so no account code begins with it, though the checksum would hold."""
    rest = next(f"{k:010d}" for k in range(98) if int("".join(str(int(c, 36)) for c in f"{k:010d}ABCSS36")) % 97 == 1)
    assert check(spark, folder({1: f"{'x ' * 21}ß 36{rest} abc b", 2: "a b DE89 3704 0044 0532 0130 00 c"}), "regex_candidates_iban")


@pytest.mark.parametrize("name", ["exact_window_match", "feature_vector", "span_attributes"])
def test_words_are_not_shuffled(spark, folder, name):
    """Pages are dealt once, as lines; only sums over pages are shuffled after that."""
    df = entry.queries()[name](spark, folder({1: "a b c 1 2 3", 2: "d e"}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    again = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "ENSURE_REQUIREMENTS" in x]
    assert all("hashpartitioning(docid#" in x and "page#" not in x for x in again), again


def test_a_text_that_is_there_is_looked_up(monkeypatch):
    """Without comparing letters: the shortest, then leftmost of equal runs."""
    from pagefold.operators import spans

    monkeypatch.setattr(spans, "SequenceMatcher", None)
    assert spans.find_span("a b c", ["x", "a b", "c", "a", "b", "c"]) == (1, 2, 1.0)
    assert spans.find_span("b c", ["b", "", "c", "b", "c", "b", "c"]) == (3, 4, 1.0)


def test_account_codes_make_runs_where_they_begin(spark):
    from pagefold.operators import codes

    words = spark.createDataFrame([(1, 0, i, w, i / 100, 0.0) for i, w in enumerate("a b DE89 3704 c".split())], "docid long, page int, word_id int, text string, left double, top double")
    assert {r.pos for r in codes.runs(words, 8, begins=codes.IBAN_START).collect()} == {2}
