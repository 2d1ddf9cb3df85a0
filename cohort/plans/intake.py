"""The ``intake`` view: one messy registration sheet row per order.

Derived from the driver's ``orders`` table so its size grows with the data;
every encoder branch is hit by a cycle on the order key (no rows are
filtered).  The rules are the FIXTURES.md contract; the DuckDB oracle
writes the same view independently in SQL (``cohort.plans.oracle``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort import contract as K

AS_OF = _dt.date(2001, 8, 1)

# FIXED VALUES: value cycles of the fixture (position = key % len).
CIVIL_CYCLE = ["Solteiro(a)", " solteira ", "CASADO", "União  Estável", "uniao estavel",
               "Divorciado(a)", "Viúvo(a)", "", None]
BENEFIT_CYCLE = ["Sim - R$ 600,00", "SIM", "Não", "nao", "1", "0", "true",
                 " Sim  -  R$ 300,00 ", "talvez", "", None]
EDUCATION_CYCLE = ["Sem escolaridade - Não alfabetizado", "Educação infantil",
                   "Ensino fundamental - 5º ano", "Ensino Fundamental - 2º ano",
                   "Ensino médio - 3º ano", "ENSINO MÉDIO", "Ensino superior - Graduação",
                   "Pós-Graduação", "Curso técnico",
                   "Educação de Jovens e Adultos (EJA) - Ensino fundamental (EJA)",
                   "desconhecido", "", None]
SCHOOL_CYCLE = ["Cursando", "Interrompido", "Concluído", " CURSANDO ", "Trancado", None]
WORK_CYCLE = ["Desempregado(a)", "Empregado com carteira de trabalho assinada", "Autônomo",
              "bico", "Dona de casa", "Não informado", "Aposentado", None]
LOOKING_CYCLE = ["Sim", "Não", "s", "N", None]
DRUGS_CYCLE = ["Não possui", "Álcool", "Sim", "não", "NÃO POSSUI", "Cocaína e crack", "",
               "Nunca", "Tabaco", None]


def _cycle(k: Column, values: list[str | None]) -> Column:
    """values[k % len(values)] as a CASE expression."""
    m = k % F.lit(len(values))
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(m == i, lit) if expr is None else expr.when(m == i, lit)
    return expr


def intake_from_orders(orders: DataFrame, extra: list[str] | None = None) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    digits = F.lpad(s(k * F.lit(7919)), 11, "0")
    cpf = (F.when(k % 29 == 0, F.lit(""))
           .when(k % 31 == 0, F.lpad(s(k * F.lit(7919)), 10, "0"))
           .when(k % 3 == 0, F.concat(F.substring(digits, 1, 3), F.lit("."),
                                      F.substring(digits, 4, 3), F.lit("."),
                                      F.substring(digits, 7, 3), F.lit("-"),
                                      F.substring(digits, 10, 2)))
           .otherwise(digits))
    idade = (F.when(k % 17 == 0, F.lit(None).cast("string"))
             .when(k % 19 == 0, F.lit("trinta"))
             .when(k % 41 == 0, F.lit("25 anos"))
             .otherwise(s(F.lit(18) + k % 60)))
    m7 = k % 7
    remuneracao = (F.when(m7 == 0, F.lit(None).cast("string"))
                   .when(m7 == 1, F.lit("a combinar"))
                   .when(m7 == 2, F.concat(F.lit("R$ 1."), F.lpad(s(k % 1000), 3, "0"),
                                           F.lit(",50")))
                   .when(m7 == 3, s(F.lit(300) + k % 1500))
                   .otherwise(F.concat(F.lit("R$ "), s(F.lit(100) + k % 800), F.lit(","),
                                       F.lpad(s(k % 100), 2, "0"))))
    data = (F.when(k % 37 == 0, F.lit("2001-01-05"))
            .when(k % 43 == 0, F.lit("31/02/2000"))
            .when(k % 47 == 0, F.lit("5/3/1999"))
            .otherwise(F.date_format(F.col("o_orderdate"), "dd/MM/yyyy")))
    return orders.select(
        k.alias("row_id"),
        F.when(k % 23 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Pessoa "), s(k))).alias("nome"),
        cpf.alias("cpf"),
        idade.alias("idade"),
        _cycle(k, CIVIL_CYCLE).alias("estado_civil"),
        _cycle(k, BENEFIT_CYCLE).alias("bolsa_familia"),
        _cycle(k, EDUCATION_CYCLE).alias("grau_escolaridade"),
        _cycle(k, SCHOOL_CYCLE).alias("situacao_escolar"),
        _cycle(k, WORK_CYCLE).alias("situacao_trabalho"),
        remuneracao.alias("remuneracao"),
        _cycle(k, LOOKING_CYCLE).alias("procurando_trabalho"),
        _cycle(k, DRUGS_CYCLE).alias("uso_drogas"),
        data.alias("data_cadastro"),
        *[F.col(c) for c in (extra or [])],
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: A task takes about this many sheet rows: a sheet's cells are many times the columns it is made of.
ROWS_PER_TASK = 250_000


def shares(df: DataFrame) -> int:
    """Tasks for a sheet of df's rows: one a core at least, and no more than about ``ROWS_PER_TASK`` rows in one."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over the cluster's cores when it arrives in fewer splits.

    Splits follow the file's bytes, which hold millions of narrow rows: a
    table with fewer splits than cores, or with splits of far more than
    ``ROWS_PER_TASK`` rows, is round-robin repartitioned (only the columns that
    are read move), so that the CPU-heavy cell encoders run on every core and
    a task's share doesn't grow with the table.
    """
    target = min_partitions or shares(df)
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake_from_orders(ensure_parallelism(read_table(spark, sf_dir, "orders")))


def to_sheet(df: DataFrame) -> DataFrame:
    """Rename canonical keys to the sheet's header text (for file fixtures)."""
    names = {**K.REQUIRED_HEADERS, **K.IDENTIFIER_HEADERS, **K.EXTRA_IDENTIFIER_HEADERS}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
