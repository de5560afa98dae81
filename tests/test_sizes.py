"""What grows with documents is shuffled: estimates from small or well-compressed files must not make the driver hold it."""

import re

import pytest

from folioscan.operators import check, rules, styles
from folioscan.plans import catalog


@pytest.mark.parametrize("name", ["check_issues", "check_score", "effective_formatting", "style_contribution", "style_cycles", "style_problems"])
def test_no_join_by_document_is_broadcast(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Broadcast\w*Join \[doc_id", plan)


@pytest.mark.parametrize("name", ["check_issues", "check_score"])
def test_no_text_is_shuffled_for_rules_that_are_left_out(spark, sf, name):
    """Pages and captions have no rules here: they are not planned at all."""
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ExistingRDD" not in plan and plan.count("SortMergeJoin") == 2


def test_the_driver_folds_no_case_of_observations(spark):
    """lower() of a literal runs in the driver; the expression that reads a caption's number stands once."""
    tw = ", ".join(f"{c} long" for c in "width_tw height_tw top_tw right_tw bottom_tw left_tw gap_tw".split())
    loc = "loc struct<part_order:int,part_ix:int,section_ix:int,table_ix:int,row_ix:int,cell_ix:int,para_ix:int,run_ix:int,rel:string>"
    sections = spark.createDataFrame([], f"doc_id long, section_ix int, {tw}, orientation string, columns int")
    effective = "effective struct<align:string,spacing_kind:string,spacing_value:long,before_tw:long,after_tw:long,first_line_tw:long>"
    paragraphs = spark.createDataFrame([], f"doc_id long, path string, {loc}, text string, style_id string, {effective}, has_direct boolean")
    fonts = "effective struct<font_ascii:string,font_hansi:string,font_ea:string,font_cs:string,size_tw:long,bold:boolean,italic:boolean>"
    runs = spark.createDataFrame([], f"doc_id long, para_path string, {loc}, text string, {fonts}")
    elements = spark.createDataFrame([], f"doc_id long, path string, {loc}, kind string, confidence decimal(3,2), status string")
    found = check.issues(check.observations(sections, paragraphs, runs, elements, rules.builtin_rules(spark)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bool:True" in plan and "bool:true" not in plan
    assert plan.count("IVXLCDM") == 1


def test_chains_of_any_shape(spark):
    """A chain of 100, a ring of 37 with two styles above it, a style based on itself, bases that don't exist."""
    chain = [(1, str(i), str(i - 1) if i else None) for i in range(100)]
    ring = [(2, str(i), str((i + 1) % 37)) for i in range(37)] + [(2, "t", "0"), (2, "u", "t")]
    df = spark.createDataFrame([*chain, *ring, (3, "l", "l"), (3, "q", "nope"), (3, "h", None)], "doc_id long, style_id string, based_on string")
    up = {(d, s): [] for d, s, _ in df.collect()}
    for d, s, depth, a in sorted(styles.ancestors(df).collect(), key=lambda r: r["depth"]):
        assert depth == len(up[d, s])
        up[d, s].append(a)
    assert up[1, "99"] == [str(i) for i in range(99, -1, -1)]
    assert up[2, "u"] == ["u", "t", *map(str, range(37))] and up[2, "5"] == [str(i % 37) for i in range(5, 42)]
    assert [up[3, s] for s in "lqh"] == [["l"], ["q"], ["h"]]
    assert sorted(map(tuple, styles.cycles(df).collect())) == sorted([(2, str(i)) for i in range(37)] + [(3, "l")])
