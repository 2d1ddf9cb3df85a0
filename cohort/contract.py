"""Column contract and fixed values.

Everything below the FIXED VALUES marker must equal the behaviour being
reproduced (header names, word lists, thresholds, labels, report wording);
it is data, stated once, in its natural order.  Code elsewhere only refers
to these names.

Columns are addressed internally by ASCII *canonical keys*; the Portuguese
header text of an input sheet is mapped onto them once, case-insensitively,
by :func:`cohort.operators.gates.resolve_headers`.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: input header contract (canonical key -> header text)
# ---------------------------------------------------------------------------
REQUIRED_HEADERS: dict[str, str] = {
    "genero": "Gênero",
    "idade": "Idade",
    "estado_civil": "Estado civil",
    "bolsa_familia": "Bolsa Família",
    "grau_escolaridade": "Grau de escolaridade",
    "situacao_escolar": "Situação escolar",
    "situacao_trabalho": "Situação de Trabalho",
    "remuneracao": "Remuneração",
    "procurando_trabalho": "Procurando trabalho",
    "uso_drogas": "Faz ou fez uso de drogas",
    "data_cadastro": "Data de Cadastro",
}

# Identifier columns accepted by the validator, in its priority order.
IDENTIFIER_HEADERS: dict[str, str] = {
    "nome_completo": "Nome completo",
    "nome": "Nome",
    "cpf": "CPF",
    "rg": "RG",
    "id": "ID",
    "identificador": "Identificador",
    "matricula": "Matrícula",
}
# Identifier priority used when scoring (console flow).
# One accepted list: validator names, then names only the console knows.
EXTRA_IDENTIFIER_HEADERS: dict[str, str] = {"id_atendido": "ID_Atendido"}

# ---------------------------------------------------------------------------
# FIXED VALUES: feature matrix
# ---------------------------------------------------------------------------
# Feature name -> (source key, Spark type), in output order.
FEATURES: list[tuple[str, str, str]] = [
    ("age", "idade", "double"),
    ("marital_status_single", "estado_civil", "int"),
    ("marital_status_married", "estado_civil", "int"),
    ("family_benefit", "bolsa_familia", "int"),
    ("education_level", "grau_escolaridade", "int"),
    ("studying", "situacao_escolar", "int"),
    ("employment_signal", "situacao_trabalho", "double"),
    ("income", "remuneracao", "double"),
    ("looking_for_job", "procurando_trabalho", "int"),
    ("substance_dependency", "uso_drogas", "int"),
    ("program_duration", "data_cadastro", "double"),
]
FEATURE_NAMES: list[str] = [f for f, _, _ in FEATURES]
# Features that may carry any decimals; the others have one at most.
FREE_DECIMALS: frozenset[str] = frozenset({"age", "income"})

# Documented weights (applied after scaling, see README "departures").
FEATURE_WEIGHTS: dict[str, float] = {
    "substance_dependency": 0.5,
    "age": 1.0,
    "education_level": 1.0,
    "family_benefit": 1.0,
    "studying": 1.0,
    "looking_for_job": 1.0,
    "employment_signal": 0.4,
    "program_duration": 1.0,
    "marital_status_single": 1.0,
    "marital_status_married": 1.0,
    "income": 1.0,
}

# Accents removed by the text key (source letters, target letters).
ACCENT_FROM = "áàãâéêíóôõúüç"
ACCENT_TO = "aaaaeeiooouuc"

# Education text key -> ordinal level.
EDUCATION_MAP: dict[str, int] = {
    "": 0,
    "sem escolaridade": 0,
    "sem escolaridade - nao alfabetizado": 0,
    "educacao infantil - educacao infantil": 0,
    "educacao infantil": 0,
    "sem escolaridade - ensino tecnico": 1,
    "educacao de jovens e adultos (eja) - ensino fundamental (eja)": 1,
    "ensino fundamental - 1 ano": 1,
    "ensino fundamental - 3 ano": 1,
    "ensino fundamental - 4 ano": 1,
    "ensino fundamental - 5 ano": 1,
    "ensino fundamental - 6 ano": 1,
    "ensino fundamental - 7 ano": 1,
    "ensino fundamental - 8 ano": 1,
    "ensino fundamental - 9 ano": 1,
    "ensino medio - 1 ano": 2,
    "ensino medio - 2 ano": 2,
    "ensino medio - 3 ano": 2,
    "ensino medio": 2,
    "ensino superior - graduacao": 3,
    "ensino superior": 3,
}
# Keyword fallback, tried in this order: (level, keywords).
EDUCATION_KEYWORDS: list[tuple[int, list[str]]] = [
    (3, ["superior", "graduacao"]),
    (2, ["medio"]),
    (1, ["fundamental", "tecnico", "eja"]),
]
# Ordinal symbols dropped before the second exact lookup.
ORDINAL_MARKS = "º°"

YES_VALUES = ["sim", "s", "1", "true", "verdadeiro", "yes", "y",
              "sim - r$ 600,00", "sim - r$ 300,00"]
NO_VALUES = ["não", "nao", "n", "0", "false", "falso", "no", ""]

SINGLE_VALUES = ["solteiro(a)", "solteiro", "solteira"]
MARRIED_VALUES = ["casado(a)", "casado", "casada", "união estável", "uniao estavel"]

STUDYING_VALUE = "cursando"

WORK_NOT_INFORMED = ["não informado", "nao informado"]
WORK_UNEMPLOYED = ["desempregado", "desempregado(a)", "desempregado (a)", "sem emprego",
                   "sem trabalho", "dona de casa", ""]
WORK_INFORMAL = ["trabalhador por conta propria (bico, autonomo)", "trabalhador por conta propria",
                 "trabalhador informal", "autonomo", "autônomo",
                 "empregado sem carteira de trabalho assinada",
                 "trabalhador por conta própria", "bico"]
WORK_FORMAL = ["empregado com carteira de trabalho assinada", "empregado com carteira assinada",
               "empregado clt", "clt", "aprendiz", "estagiario", "estagiário"]
SIGNAL_FORMAL, SIGNAL_INFORMAL, SIGNAL_NONE = 1.0, 0.6, 0.0

SUBSTANCE_NONE_VALUE = "não possui"

# Registration date pattern (day/month/year, one or two digit day and month).
DATE_PATTERNS = ["d/M/yyyy"]
DAYS_PER_MONTH = 30.0

# Cells that mean "missing" besides null (cell predicate).
MISSING_WORDS = ["", "nan", "none"]
# Missing-value tokens of a delimited-text reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# Probe order of the delimited-text scanner.
PROBE_ENCODINGS = ["UTF-8", "ISO-8859-1"]
PROBE_DELIMITERS = [",", ";", "\t"]

# ---------------------------------------------------------------------------
# FIXED VALUES: model selection
# ---------------------------------------------------------------------------
K_MIN, K_MAX = 2, 5
N_INIT, MAX_ITER, SEED = 10, 300, 42
SILHOUETTE_FLOOR = 0.15
FALLBACK_K = 2
CONFIDENCE_MIN, CONFIDENCE_MAX, CONFIDENCE_FLAT = 30.0, 95.0, 50.0

# ---------------------------------------------------------------------------
# FIXED VALUES: cluster score (feature, [(op, threshold, points)]), first hit wins
# ---------------------------------------------------------------------------
SCORE_RULES: list[tuple[str, list[tuple[str, float, float]]]] = [
    ("education_level", [(">=", 2.5, 1.5), (">=", 1.5, 1.0), (">", 0.0, 0.5)]),
    ("income", [(">=", 1200.0, 2.0), (">", 600.0, 1.0)]),
    ("looking_for_job", [(">=", 0.5, 2.0), (">=", 0.2, 1.0)]),
    ("studying", [(">=", 0.2, 1.0)]),
    ("employment_signal", [(">=", 0.8, 1.0), (">=", 0.4, 0.5)]),
    ("program_duration", [(">=", 18.0, 1.0), (">=", 12.0, 0.5)]),
    ("family_benefit", [(">=", 0.7, -0.5)]),
    ("substance_dependency", [("<=", 0.4, 1.0), (">=", 0.9, -1.0)]),
]

LABEL_RELEASE = "Possível Liberação"
LABEL_MONITOR = "Monitoramento Ativo"
LABEL_INTENSIVE = "Apoio Intensivo"
LABEL_SINGLE = "Perfil Único"
LABEL_DEFAULT_PREFIX = "Cluster "

# Label -> risk level (documented three levels); anything else is RISK_DEFAULT.
RISK_BY_LABEL: dict[str, str] = {LABEL_RELEASE: "Baixo", LABEL_MONITOR: "Médio"}
RISK_DEFAULT = "Alto"
# Wording of a record's training section.
TRAINING_CONTEXT = "Contexto do modelo: "
TRAINING_NOTES = "Indicadores observados no treinamento original:"
MODEL_SECTION = "====== Informações sobre o modelo ======"
MODEL_UNKNOWN = "Metadados não disponíveis no momento."
# Labels that the labeller gives: the domain of distributions and of the text sink.
EMITTED_LABELS = [LABEL_RELEASE, LABEL_MONITOR, LABEL_INTENSIVE, LABEL_SINGLE]
# Fixed domains of the text sink's zero-filled distributions: names of an older labeller, and the risks.
TEXT_SINK_LABELS = ["Apto", "Acompanhamento", "Não Apto"]
TEXT_SINK_RISKS = ["Baixo", "Médio", "Alto"]

# Education mean -> phrase: (threshold op, value, phrase); else EDU_PHRASE_NONE.
EDU_PHRASES = [(">=", 2.5, "Predomínio de Ensino Médio ou Superior"),
               (">=", 1.5, "Predomínio de Ensino Fundamental completo"),
               (">", 0.0, "Predomínio de Ensino Fundamental inicial")]
EDU_PHRASE_NONE = "Sem escolaridade informada"

# ---------------------------------------------------------------------------
# FIXED VALUES: insight catalogue (label, summary, details)
# ---------------------------------------------------------------------------
INSIGHT_DISCLAIMER = (
    "OBSERVAÇÃO IMPORTANTE: Este modelo inicial foi treinado com uma amostra reduzida,\n"
    "servindo apenas como apoio às equipes técnicas. Sempre confirme as sugestões com\n"
    "avaliação humana especializada."
)
INSIGHTS: list[tuple[str, str, list[str]]] = [
    (LABEL_RELEASE,
     "Perfil com autonomia crescente e prontidão para transição assistida.",
     ["Indicadores de renda e ocupação apontam capacidade crescente de sustentação própria.",
      "Busca ativa por trabalho e continuidade educacional sustentam a transição.",
      "Investigue se permanecem barreiras ocultas (como dependência química) antes do desligamento.",
      "Planeje roteiro de acompanhamento pós-saída para evitar rupturas abruptas.",
      "Utilize os dados para conectar o participante a vagas, cursos e monitoramento remoto.",
      INSIGHT_DISCLAIMER]),
    (LABEL_INTENSIVE,
     "Perfil com vulnerabilidades acumuladas que exige apoio contínuo e intensivo.",
     ["Demanda articulação multidisciplinar entre assistência social, saúde e geração de renda.",
      "Avalie sinais de dependência química, saúde mental e física para priorizar intervenções.",
      "Fortaleça vínculos com redes de proteção social e serviços especializados.",
      "Priorize atividades práticas que desenvolvam habilidades profissionais e educacionais.",
      "Registre metas de curto prazo e indicadores monitorados semanalmente pela equipe.",
      INSIGHT_DISCLAIMER]),
    (LABEL_MONITOR,
     "Perfil intermediário com avanços parciais e necessidade de supervisão próxima.",
     ["Oscilações em renda, estudo ou vínculo laboral requerem acompanhamento estruturado.",
      "Mapeie gatilhos de regressão (incluindo recaídas em uso de substâncias) para respostas rápidas.",
      "Mantenha reuniões periódicas para recalibrar o plano individual conforme evolução.",
      "Aproveite os dados para direcionar mentorias, oficinas e intervenções específicas.",
      INSIGHT_DISCLAIMER]),
]
NO_SUMMARY = "Sem resumo disponível para este cluster."

# ---------------------------------------------------------------------------
# FIXED VALUES: report wording
# ---------------------------------------------------------------------------
NOT_INFORMED = "Não informado"
RELEASE_NOTES_HEADER = "📝 Motivos da classificação 'Possível Liberação':"
RELEASE_NOTES_MARKER = "Motivos da classificação 'Possível Liberação'"
RELEASE_NOTES_FALLBACK = ("Indicadores específicos desse cluster não foram identificados "
                          "durante o treinamento.")
RULE = "=" * 70

# Raw attributes shown in the batch report: (source key, shown name).
RECORD_ATTRIBUTES = [
    ("idade", "Idade"),
    ("situacao_trabalho", "Situação de trabalho"),
    ("remuneracao", "Renda declarada"),
    ("procurando_trabalho", "Busca por trabalho"),
    ("situacao_escolar", "Situação escolar"),
    ("bolsa_familia", "Recebe Bolsa Família"),
]

# Action plan sentences per label: (label, first, with dependency, without, rest...).
ACTION_PLAN: dict[str, tuple[str, str, str, list[str]]] = {
    LABEL_INTENSIVE: (
        "Realizar reunião interdisciplinar para montar plano intensivo nos próximos 30 dias.",
        "Agendar avaliação especializada de dependência química e garantir adesão ao tratamento indicado.",
        "Manter rastreio periódico de dependência química e saúde mental, mesmo sem relato atual.",
        ["Utilizar os dados socioeconômicos para priorizar benefícios, oficinas e acompanhamento familiar.",
         "Registrar evolução semanal em prontuário e revisar metas curtas com a equipe técnica."]),
    LABEL_RELEASE: (
        "Construir plano de transição assistida com check-ins quinzenais até o desligamento.",
        "Confirmar estabilidade no tratamento de dependência química antes da liberação definitiva.",
        "Estabelecer rede de apoio para prevenir recaídas em dependência química após o desligamento.",
        ["Aproveitar os dados para alinhar encaminhamentos de trabalho, educação e suporte financeiro.",
         "Documentar fatores que sustentam a autonomia para futuras reavaliações da ONG."]),
    LABEL_MONITOR: (
        "Programar acompanhamento mensal com indicadores claros de avanço e alerta.",
        "Monitorar possíveis recaídas em dependência química e acionar rede especializada quando necessário.",
        "Oferecer orientações preventivas sobre dependência química, mesmo sem relato atual.",
        ["Direcionar os dados coletados para mentorias, oficinas e intervenções específicas conforme evolução."]),
}
ACTION_DEFAULT = ("Utilizar os dados disponíveis para construir plano individual com metas e "
                  "monitoramento periódico.")
ACTION_JOB_NO = ("Promover mentoria para retomada da busca ativa por trabalho e articular com "
                 "empregadores parceiros.")
ACTION_JOB_YES = ("Acompanhar semanalmente as candidaturas em andamento para garantir continuidade "
                  "do engajamento.")
ACTION_STUDY_STOPPED = "Oferecer apoio para retomada educacional (EJA, cursos rápidos ou reforço)."
ACTION_STUDY_ONGOING = "Garantir suporte para permanência na trajetória educacional atual."
ACTION_INCOME = ("Avaliar alternativas de geração de renda emergencial enquanto o emprego formal "
                 "não acontece.")
ACTION_RISK = "Registrar no prontuário que o risco identificado está classificado como {risk}."
ACTION_CLOSING = ("Atualize o prontuário com estes indicadores para fortalecer a tomada de decisão "
                  "baseada em evidências.")
UNEMPLOYED_TOKENS = ["desempregado", "sem emprego", "dona de casa"]
DEPENDENCY_NEGATIVE_TOKENS = ["ausente", "negado", "sem", "não", "nao"]
