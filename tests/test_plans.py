"""Plans: what must not shuffle or run Python does not."""

import re

import pytest

from docloom import plans
from docloom.operators import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["text_dedupe_lines", "text_trim_lines", "text_case", "tokenize_counts", "html_escape", "net_pay", "severance", "annual_leave_hire", "business_days_weekends", "signal_normalize", "signal_resample", "contain_cover", "output_dims", "zone_convert"])
def test_row_wise_queries_do_not_shuffle(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert plans.shuffles(df) == 0 and not plans.uses_python(df)


@pytest.mark.parametrize("name", ["range_format", "sheet_trim_rows", "merge_vertical", "diff_classify", "lookup_last_wins", "meeting_slots"])
def test_relational_queries_run_no_python(spark, name):
    assert not plans.uses_python(catalogue.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["text_dedupe_lines", "text_trim_lines", "tokenize_counts", "char_ngram_dice"])
def test_no_lambda_works_on_the_whole_text(spark, name):
    """What is made of the whole text is made once, not once for each line or gram."""
    df = catalogue.queries()[name](spark, SF)
    for tree in (df._jdf.queryExecution().optimizedPlan().toString(),):
        for body in re.findall(r"lambdafunction\(((?:[^()]|\([^()]*\))*)", tree):
            assert not re.search(r"(split|lower)\(text#", body), body
