import pytest

from casewise.config import REQUIRED_COLUMNS, CasewiseError
from casewise.operators import profile
from casewise.plans.eda import eda_report
from casewise.sources import records as source

HEADER = "id_registro,texto,canal_origem,data,classe_macro,classe_detalhada\n"


def write(tmp_path, text, name="dados.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_scan_keeps_quoted_breaks_and_reads_missing_values(spark, tmp_path):
    path = write(
        tmp_path,
        " texto ,id_registro,canal_origem,data,classe_macro,classe_detalhada,extra\n"
        '"linha 1\nlinha ""2""",1,email,2026-04-04,Suporte,NA,x\n'
        "outro,2,,2026-04-05, Suporte,null,y\n",
    )
    first, second = source.load_records(spark, path).orderBy("id_registro").collect()
    assert first.texto == 'linha 1\nlinha "2"' and first.classe_detalhada is None and first.extra == "x"
    assert second.canal_origem is None and second.classe_macro == " Suporte" and second.classe_detalhada is None


def test_csv_errors(spark, tmp_path):
    with pytest.raises(CasewiseError, match="não possui linhas"):
        source.load_records(spark, write(tmp_path, HEADER))
    with pytest.raises(CasewiseError, match="não possui"):
        source.load_records(spark, write(tmp_path, "", "vazio.csv"))
    with pytest.raises(CasewiseError, match="canal_origem, data, classe_macro, classe_detalhada"):
        source.load_records(spark, write(tmp_path, "id_registro,texto\n1,a\n", "faltam.csv"))
    with pytest.raises(CasewiseError):
        source.load_records(spark, str(tmp_path / "nada.csv"))


def test_landing_never_overwrites_and_latest_batch_wins(spark, tmp_path, make_records):
    landing = str(tmp_path / "landing")
    old = make_records([(1, "a", "M", "D")])
    new = make_records([(2, "b", "M", "D"), (3, "c", "M", "D")])
    assert source.land_batch(old, landing, batch="b1") == "b1"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        source.land_batch(new, landing, batch="b1")
    source.land_batch(new, landing, batch="b2")
    source.land_batch(old, landing, source="demo", batch="b9")
    landed = source.read_landing(spark, landing)
    assert landed.count() == 4
    assert {r.id_registro for r in source.latest_batch(landed).collect()} == {"2", "3"}
    assert {r.id_registro for r in source.latest_batch(landed, preferred="b1").collect()} == {"1"}
    assert {r.id_registro for r in source.latest_batch(landed, preferred="gone").collect()} == {"2", "3"}
    assert {r.id_registro for r in source.latest_batch(landed, source="demo").collect()} == {"1"}
    assert source.land_batch(old, landing) < source.land_batch(old, landing)
    with pytest.raises(CasewiseError):
        source.latest_batch(landed, source="outra")


def test_files_with_columns_in_another_order(spark, tmp_path):
    names = list(REQUIRED_COLUMNS)
    write(tmp_path, ",".join(names) + "\n" + "1,ola,email,2026-01-01,M,D\n", "a.csv")
    write(tmp_path, " ,".join(reversed(names)) + '\nE,N,2026-01-02,chat,"oi, ""tudo""\nbem",2\n', "b.csv")
    write(tmp_path, ",".join(names) + ",extra\n3,fim\n", "c.csv")
    rows = {r.id_registro: r for r in source.load_records(spark, f"{tmp_path}/*.csv").collect()}
    assert (rows["1"].texto, rows["1"].classe_macro, rows["1"].classe_detalhada) == ("ola", "M", "D")
    assert (rows["2"].texto, rows["2"].classe_macro, rows["2"].classe_detalhada) == ('oi, "tudo"\nbem', "N", "E")
    assert (rows["3"].texto, rows["3"].classe_macro, rows["3"].extra) == ("fim", None, None)


@pytest.mark.parametrize("multiline", [True, False])
def test_unreadable_files_are_refused(spark, tmp_path, multiline):
    header = ",".join(REQUIRED_COLUMNS) + "\n"
    long = write(tmp_path, header + "1,a,b,c,d,e,f,g\n", "long.csv")
    latin = tmp_path / "latin.csv"
    latin.write_bytes((header + "1,cobrança,b,c,d,e\n").encode("latin-1"))
    twice = write(tmp_path, header.strip() + ",texto\n1,a,b,c,d,e,f\n", "twice.csv")
    for path in (long, latin, twice, tmp_path / "none.csv"):
        with pytest.raises(CasewiseError):
            source.load_records(spark, str(path), multiline)
    good = write(tmp_path, header + "1,a,b,c,d\n2,a,b,c,d,e\n", "good.csv")
    assert source.load_records(spark, str(good), multiline).count() == 2


def test_batches_are_ordered_by_arrival_and_keep_their_names(spark, tmp_path, make_records):
    landing = str(tmp_path / "landing")
    for at, batch in enumerate(("9", "10", "007")):
        source.land_batch(make_records([(at, "a", "M", "D")]), landing, batch=batch)
    landed = source.read_landing(spark, landing)
    assert {r.batch for r in landed.collect()} == {"9", "10", "007"}
    assert source.latest_batch(landed).first().batch == "007"
    assert source.latest_batch(landed, preferred="9").first().id_registro == "0"
    assert source.latest_batch(landed, preferred="7").first().batch == "007"


def test_newest_files(spark, tmp_path):
    import os

    for at, name in enumerate(("a.csv", "b.csv", "c.txt")):
        os.utime(write(tmp_path, "x", name), (1_700_000_000 + at, 1_700_000_000 + at))
    names = [row.path.rsplit("/", 1)[1] for row in source.newest_files(spark, str(tmp_path)).collect()]
    assert names == ["b.csv", "a.csv"]


@pytest.mark.parametrize(
    "requested, current, by_default, expected",
    [(" Demo ", None, False, "demo"), (None, "demo", False, "demo"), ("x", None, True, "demo"), (None, None, False, "upload")],
)
def test_resolve_source(requested, current, by_default, expected):
    assert source.resolve_source(requested, current, by_default) == expected


def test_schema_check_and_preview(spark, make_records):
    df = make_records([(10, "a", "M", None), (9, "b", None, "D")])
    rows = {r.coluna_esperada: (r.presente_no_dataset, r.registros_preenchidos) for r in source.schema_check(df).collect()}
    assert rows["classe_macro"] == (True, 1) and rows["texto"] == (True, 2)
    part = {r.coluna_esperada: r.presente_no_dataset for r in source.schema_check(df.drop("data")).collect()}
    assert part["data"] is False
    assert [(r.id_registro, r.classe_macro) for r in source.dataset_preview(df).collect()] == [("9", ""), ("10", "M")]
    summary = source.dataset_summary(df).first()
    assert (summary.row_count, summary.column_count, summary.columns) == (2, 6, ", ".join(REQUIRED_COLUMNS))


def test_eda_report(spark, make_records):
    df = make_records(
        [(1, "Consulta de pedido aberto", "Atendimento", "Consulta"), (2, "abc", "Suporte", "Abertura"), (3, None, "Atendimento", None)]
    )
    report = eda_report(df)
    assert [(r.label, r.value) for r in report["macro"].collect()] == [("Atendimento", 2), ("Suporte", 1)]
    assert [(r.label, r.value) for r in report["detailed_top"].collect()] == [("Abertura", 1), ("Consulta", 1), ("Não informado", 1)]
    stats = report["text_stats"].first()
    assert (stats.avg_chars, stats.avg_words) == (9.33, 1.67)
    assert (stats.shortest_size, stats.shortest_preview) == (0, "-")
    assert stats.longest_preview == "Consulta de pedido aberto"
    overview = {r.indicador: r.valor for r in report["overview"].collect()}
    assert overview == {"total_registros": 3, "total_colunas": 6, "macroclasses": 2, "classes_detalhadas": 2, "canais_origem": 1}
    examples = report["examples_by_macro"].orderBy("macro_class", "posicao").collect()
    assert [(r.macro_class, r.id_registro, r.texto) for r in examples][:2] == [
        ("Atendimento", "1", "Consulta de pedido aberto"), ("Atendimento", "3", "-"),
    ]
    with pytest.raises(CasewiseError):
        eda_report(df.limit(0))


def test_first_per_group_limits_before_the_shuffle(spark, make_records):
    df = profile.sample_by_macro(make_records([(1, "a", "M", "D")]))
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
