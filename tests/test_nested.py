from conftest import rows

from skein.operators import nested


def make(spark, sql):
    return spark.sql(sql)


ROW = """select {id} as report_id, 'p' as project_id, 'v' as schema_version, named_struct('tool_version', '1', 'generated_at', 'now') as meta,
 named_struct('affected_packages', array('a', cast(null as string), 'a'), 'analysis_summary', cast(null as struct<total_files:bigint,highest_severity:string,breaking_changes_detected:boolean,severity_distribution:map<string,int>>),
 'context', cast(null as struct<repository:string,branch:string,commit_sha:string,author:string>)) as report,
 array(cast(null as struct<id:string,source:string,severity:string,symbol_mutations:array<struct<symbol_name:string,file_path:string,baseline_hash:string,current_hash:string>>,contract_breaks:array<struct<endpoint:string,change_type:string,baseline_value:string,current_value:string,severity:string>>,middleware_breaks:array<struct<scope:string,change_type:string,middleware_name:string,severity:string,details:map<string,string>>>,affected_symbols:array<string>,propagation_chain:array<string>>),
  named_struct('id', 'c', 'source', 's', 'severity', 'MAJOR', 'symbol_mutations', array(null, named_struct('symbol_name', 'f', 'file_path', 'x', 'baseline_hash', '1', 'current_hash', '2')),
   'contract_breaks', cast(null as array<struct<endpoint:string,change_type:string,baseline_value:string,current_value:string,severity:string>>),
   'middleware_breaks', array(named_struct('scope', 'g', 'change_type', 'x', 'middleware_name', cast(null as string), 'severity', 'MINOR', 'details', map('k', 'v'))),
   'affected_symbols', array('q'), 'propagation_chain', cast(array() as array<string>))) as breaking_changes,
 timestamp_ntz'2025-01-0{day} 00:00:00' as ingested_at, 'clash' as tag, 'clash' as payload"""


def test_items_once_per_report(spark):
    df = make(spark, ROW.format(id="'r'", day=1) + " union all " + ROW.format(id="'r'", day=2))
    assert rows(nested.report_items(df)) == [
        ("r", 0, "affected_package", 1, "a"), ("r", 0, "affected_package", 3, "a"), ("r", 2, "middleware_break", 1, None), ("r", 2, "symbol_mutation", 2, "f"),
    ]
    tables = nested.flat_tables(df)
    change = tables["breaking_change"].collect()
    assert [(r["pk"], r["parent_pk"], r["id"]) for r in change] == [("r/breaking_change/2/0", "r/report/0/0", "c")]
    assert tables["symbol_mutation"].select("parent_pk").collect()[0][0] == "r/breaking_change/2/0"
    assert tables["analysis_summary"].count() == 0


def test_null_ids_and_empty(spark):
    df = make(spark, ROW.format(id="cast(null as string)", day=1))
    assert len(rows(nested.report_items(df))) == 4
    assert rows(nested.report_items(df.where("false"))) == []
