"""Report cell functions: display text derived from raw cells and scores.

All are ``Column`` expressions; sentence lists are arrays built with
``F.array`` + ``F.filter`` so a whole per-record report is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort import contract as K
from cohort.functions.encode import to_number
from cohort.functions.text import clean_text, col, fixed, once, strip_u


def masked_value(column_name: str, c: str | Column) -> Column:
    """The value as text, an 11-digit CPF shown as ddd.***.***-dd; null stays null, a masked value stays as it is."""
    text = col(c).cast("string")
    if column_name.strip().lower() != "cpf":
        return text
    return once(text, _masked)


def _masked(text: Column) -> Column:
    return once(F.regexp_replace(text, r"\D", ""), lambda digits: F.when(F.length(digits) == 11, F.concat(
        F.substring(digits, 1, 3), F.lit(".***.***-"), F.substring(digits, 10, 2))).otherwise(text))


def mask_identifier(column_name: str, c: str | Column) -> Column:
    """'<column>: <value>' with an 11-digit CPF shown as ddd.***.***-dd; blank -> ''."""
    def shown(text: Column) -> Column:
        return _masked(text) if column_name.strip().lower() == "cpf" else text

    meant = lambda text: text.isNotNull() & ~F.lower(text).isin(*K.MISSING_WORDS)
    return once(strip_u(col(c).cast("string")), lambda text: F.when(meant(text), F.concat(F.lit(f"{column_name}: "), shown(text))).otherwise(F.lit("")))


def format_confidence(c: str | Column) -> Column:
    """'x.x%' from a number or percent text (values <= 1 are fractions)."""
    text = clean_text(c)
    norm = F.translate(F.replace(F.replace(text, F.lit("%"), F.lit("")), F.lit(" "), F.lit("")),
                       ",", ".")
    n = to_number(norm)
    n = F.when(n <= 1, n * 100).otherwise(n)
    return (F.when(text == "", F.lit(K.NOT_INFORMED))
            .when(n.isNotNull(), F.concat(fixed(n, 1), F.lit("%")))
            .otherwise(text))


def _fold(c: Column, pairs: str, to: str) -> Column:
    return F.translate(c, pairs, to)


def dependency_info(c: str | Column) -> Column:
    """struct(flag, text): reported substance use for the report texts."""
    def info(raw: Column) -> Column:
        s = _fold(F.lower(raw), "ãõâêé", "aoaee")
        negative = None
        for tok in K.DEPENDENCY_NEGATIVE_TOKENS:
            hit = s.contains(tok)
            negative = hit if negative is None else (negative | hit)
        flag = F.when(raw == "", F.lit(False)).when(negative & ~s.contains("sim"), F.lit(False)) \
            .otherwise(F.lit(True))
        return F.struct(flag.alias("flag"), raw.alias("text"))

    return once(clean_text(c), info)


def format_currency(c: str | Column) -> Column:
    """Brazilian currency text 'R$ 1.234,56'; unparsable text is kept; blank -> ''."""
    def amount(cleaned: Column) -> Column:
        normalized = F.translate(F.replace(cleaned, F.lit("."), F.lit("")), ",", ".")
        return F.coalesce(to_number(normalized), to_number(cleaned))

    def shown(text: Column) -> Column:
        cleaned = F.replace(F.replace(F.replace(text, F.lit("R$"), F.lit("")), F.lit("r$"),
                                      F.lit("")), F.lit(" "), F.lit(""))
        money = lambda n: F.concat(F.lit("R$ "), F.translate(F.format_number(n, 2), ",.", ".,"))
        return F.when(text == "", F.lit("")).otherwise(
            once(once(cleaned, amount), lambda n: F.when(n.isNotNull(), money(n)).otherwise(text)))

    return once(clean_text(c), shown)


def yes_no(c: str | Column) -> Column:
    """'Sim' / 'Não' / 'Não informado' / original text."""
    def answer(text: Column) -> Column:
        low = F.lower(text)
        s = _fold(low, "ãõ", "ao")
        return (F.when(text == "", F.lit(K.NOT_INFORMED))
                .when(s.contains("sim"), F.lit("Sim"))
                .when(s.contains("nao") | low.contains("não"), F.lit("Não"))
                .otherwise(text))

    return once(clean_text(c), answer)


def observed_factors(rec: dict[str, Column], dep: Column) -> Column:
    """Up to seven sentences about the raw record (``dep`` = dependency_info)."""
    def opt(key: str):
        return rec.get(key, F.lit(None).cast("string"))
    def dependency(d: Column) -> Column:
        text = d.getField("text")
        return (F.when(d.getField("flag"), F.concat(
            F.lit("Dependência química relatada: "),
            F.when(text == "", F.lit("presença informada")).otherwise(text)))
            .when(text != "", F.concat(F.lit("Dependência química: "), text))
            .otherwise(F.lit("Dependência química: não há registro atualizado no cadastro.")))

    def told(said: str, value: Column, unless: str = "") -> Column:
        return once(value, lambda v: F.when(v != unless, F.concat(F.lit(said), v)))

    items = F.array(
        told("Idade informada: ", clean_text(opt("idade"))),
        told("Situação de trabalho declarada: ", clean_text(opt("situacao_trabalho"))),
        told("Renda declarada: ", format_currency(opt("remuneracao"))),
        told("Situação escolar atual: ", clean_text(opt("situacao_escolar"))),
        told("Busca por trabalho: ", yes_no(opt("procurando_trabalho")), K.NOT_INFORMED),
        told("Recebe Bolsa Família: ", yes_no(opt("bolsa_familia")), K.NOT_INFORMED),
        once(dep, dependency),
    )
    return F.filter(items, lambda x: x.isNotNull())


def action_plan(label: Column, risk: Column, dep_flag: Column, rec: dict[str, Column]) -> Column:
    """Suggested actions: label x dependency sentences, then record-driven ones."""
    def opt(key: str):
        return rec.get(key, F.lit(None).cast("string"))
    def by_label(lab: Column) -> Column:
        found = None
        for name, (first, with_dep, without_dep, rest) in K.ACTION_PLAN.items():
            arr = F.array(F.lit(first), F.when(dep_flag, F.lit(with_dep)).otherwise(F.lit(without_dep)),
                          *[F.lit(r) for r in rest])
            found = F.when(lab == name, arr) if found is None else found.when(lab == name, arr)
        return found.otherwise(F.array(F.lit(K.ACTION_DEFAULT)))

    def unemployed(work: Column) -> Column:
        found = None
        for tok in K.UNEMPLOYED_TOKENS:
            hit = work.contains(tok)
            found = hit if found is None else (found | hit)
        return F.when((work != "") & found, F.lit(K.ACTION_INCOME))

    folded = lambda key: _fold(F.lower(clean_text(opt(key))), "çã", "ca")
    tail = F.array(
        once(yes_no(opt("procurando_trabalho")), lambda job: F.when(job == "Não", F.lit(K.ACTION_JOB_NO)).when(job == "Sim", F.lit(K.ACTION_JOB_YES))),
        once(folded("situacao_escolar"), lambda study: F.when(study.contains("interromp"), F.lit(K.ACTION_STUDY_STOPPED))
             .when(study.contains("cursando"), F.lit(K.ACTION_STUDY_ONGOING))),
        once(folded("situacao_trabalho"), unemployed),
        once(clean_text(risk), lambda rsk: F.when(rsk != "", F.replace(F.lit(K.ACTION_RISK), F.lit("{risk}"), rsk))),
        F.lit(K.ACTION_CLOSING),
    )
    return F.concat(once(clean_text(label), by_label), F.filter(tail, lambda x: x.isNotNull()))


def record_attributes(rec: dict[str, Column]) -> Column:
    """array<struct(position, attribute, value)> of the six shown raw cells;
    blank or 'nan' cells are omitted."""
    def item(i: int, key: str, shown: str) -> Column:
        keep = lambda text: text.isNotNull() & (text != "") & (F.lower(text) != "nan")
        return once(strip_u(rec[key].cast("string")), lambda text: F.when(keep(text), F.struct(
            F.lit(i).alias("position"), F.lit(shown).alias("attribute"), text.alias("value"))))

    items = [item(i, key, shown) for i, (key, shown) in enumerate(K.RECORD_ATTRIBUTES, start=1) if key in rec]
    return F.filter(F.array(*items), lambda x: x.isNotNull())
