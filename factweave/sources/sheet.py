"""The whole data sheet: the analyses of binding with every field of the main table, and its mapping to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources import binding
from factweave.sources.mapping import DECIMAL, INTEGER, Constant, Entity, Ref, Template, triples

DATA, ONT, VOCAB = binding.DATA, binding.ONTOLOGY, binding.VOCAB
SPORT, TOOLS = "urn:kg/sport-vocab/", "urn:kg/tools-vocab/"


def text_of(x: str) -> str:
    return f"CAST({x} AS STRING)"


#: Fields that binding doesn't have, as SQL over its columns that Spark and DuckDB read alike.
FIELDS = {
    "doi": "'10.1000/' || article_id",
    "title": "'Study ' || article_id || ': \"' || country || '\"; part one. End'",
    "authors": f"'Author ' || {text_of('l_orderkey % 97')} || '; Author ' || {text_of('l_orderkey % 89')}",
    "journal": "CASE WHEN l_orderkey % 6 = 0 THEN '' ELSE 'Journal of ' || continent END",
    "relation_degree": "CASE l_linenumber % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' END",
    "analysis_type": "CASE l_suppkey % 4 WHEN 0 THEN 'Correlation' WHEN 1 THEN 'Regression' WHEN 2 THEN 'ANOVA' ELSE ' ' END",
    "conclusion": "CASE WHEN l_partkey % 4 = 0 THEN 'Line one' || chr(10) || 'line \"two\"' END",
    "limits": "CASE WHEN l_partkey % 7 = 0 THEN 'Small sample; one site.' END",
    "perspectives": "CASE WHEN l_partkey % 9 = 0 THEN 'More (100 %) work' END",
    "moderator_measure": f"CASE WHEN moderator IS NOT NULL THEN 'Scale M' || {text_of('l_partkey % 9')} END",
    "mediator_measure": f"CASE WHEN mediator <> 'N.A.' THEN 'Scale D' || {text_of('l_partkey % 5')} END",
    "mediator_name": "CASE WHEN mediator <> 'N.A.' THEN mediator END",
    "n_sports": text_of("l_partkey % 4 + 1"),
    "stats_group": f"'Group ' || {text_of('l_linenumber')}",
    "p_sign": "CASE l_suppkey % 3 WHEN 0 THEN '<' WHEN 1 THEN '=' END",
    "degree_beta_raw": f"CASE WHEN l_partkey % 2 = 0 THEN '0,' || {text_of('l_partkey % 90 + 10')} END",
    "degree_r2_raw": f"CASE WHEN l_partkey % 3 = 0 THEN '0,' || {text_of('l_suppkey % 90 + 10')} END",
    "secondary_degree": "CASE WHEN l_linenumber = 2 THEN 'indirect' END",
    "vd_measure": "CASE l_suppkey % 4 WHEN 0 THEN 'EAT-26' WHEN 1 THEN 'EDI 2 (short)' WHEN 2 THEN 'BULIT-R' END",
    "vi_measure": "CASE l_partkey % 5 WHEN 0 THEN 'RSE' WHEN 1 THEN 'EAT-26' WHEN 2 THEN 'SPAS/7' END",
    "vd_specification": "CASE WHEN l_suppkey % 6 = 0 THEN 'last month' END",
    "vi_specification": "CASE WHEN l_partkey % 6 = 0 THEN 'at rest' END",
    "population": "'Athletes of ' || country",
    "subgroup": f"CASE WHEN l_suppkey % 3 = 0 THEN 'Part ' || {text_of('l_suppkey % 9')} END",
    "sporting_population": "CASE WHEN gender <> 'N.A.' THEN gender || ' athletes' END",
    "inclusion": "CASE WHEN l_suppkey % 8 = 0 THEN 'Age > 15' END",
    "sport_level": "CASE l_orderkey % 3 WHEN 0 THEN 'Elite' WHEN 1 THEN 'Amateur' END",
    "age_min_raw": "CASE WHEN left(age_range_raw, 1) = '[' THEN split_part(replace(replace(age_range_raw, '[', ''), ']', ''), '-', 1) END",
    "age_max_raw": "CASE WHEN left(age_range_raw, 1) = '[' THEN split_part(replace(replace(age_range_raw, '[', ''), ']', ''), '-', 2) END",
    "age_sd_raw": "CASE WHEN l_linenumber <> 1 THEN '2,1' END",
    "bmi_mean_raw": f"CASE WHEN l_linenumber % 2 = 0 THEN 'M=' || {text_of('l_partkey % 12 + 18')} || ',5' ELSE 'N.A.' END",
    "bmi_range_raw": f"CASE WHEN l_linenumber % 4 = 0 THEN '[' || {text_of('l_partkey % 5 + 16')} || '-' || {text_of('l_partkey % 9 + 25')} || ']' END",
    "exp_range_raw": "'[' || exp_min_raw || '-' || exp_max_raw || ']'",
}


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each analysis, with all fields as text."""
    return binding.analyses(spark, sf_dir).withColumns({k: F.expr(v) for k, v in FIELDS.items()})


def P(name: str) -> str:
    return ONT + name


def _of(kind: str) -> Template:
    return Template(DATA + kind + "_{analysis_id}")


def _plain(columns: dict[str, str | Ref]) -> dict:
    return {P(k): v if isinstance(v, Ref) else Ref(v) for k, v in columns.items()}


def _statistics(name: str, cls: str, columns: dict[str, str | Ref]) -> Entity:
    return Entity(name, _of(name), (P(cls),), _plain(columns), own=True)


SPORT_IRI, VD_IRI, VI_IRI = Template(SPORT + "{sport_name}"), _of("Variable_VD"), _of("Variable_VI")
ARTICLE = Template(DATA + "Article_{article_id}")
ENTITIES = (
    Entity("Article", ARTICLE, (P("SportPsychologyArticle"),), {
        **_plain({"doi": "doi", "title": "title", "date": Ref("article_year", INTEGER), "creator": "authors", "journal": "journal", "country": "country", "continent": "continent", "studyType": "study_type"}),
    }),
    Entity("ArticleLink", ARTICLE, (), {P("hasAnalysis"): _of("Analysis")}, own=True),
    Entity("Analysis", _of("Analysis"), (P("Analysis"),), {
        **_plain({
            "analysisId": "analysis_id", "relationDegree": "relation_degree", "typeOfAnalysis": "analysis_type", "authorConclusion": "conclusion", "limites": "limits", "perspectives": "perspectives",
            "moderatorMeasure": "moderator_measure", "mediatorMeasure": "mediator_measure", "sportPracticeType": "practice_type", "numberOfSportStudied": Ref("n_sports", INTEGER),
            "sampleSizeMobilized": Ref("sample_size_raw", INTEGER), "complexityOfAnalysis": "complexity", "relationDirection": "relation_direction", "groupStatisticalAnalysis": "stats_group"}),
        P("hasPopulation"): _of("Population"), P("hasSport"): SPORT_IRI, P("hasRelation"): _of("Relations"), P("hasSubgroup"): Template(DATA + "Subgroup_{analysis_id}_{subgroup}"),
        P("hasMediator"): Template(VOCAB + "{mediator_name}"), P("hasModerator"): Template(VOCAB + "{moderator}"),
    }, own=True),
    Entity("Population", _of("Population"), (P("Population"),), {
        **_plain({"gender": "gender", "sampleSize": Ref("sample_size_raw", INTEGER), "population": "population", "sportingPopulation": "sporting_population", "inclusionCriteria": "inclusion", "sportLevel": "sport_level"}),
        P("ageStats"): _of("AgeStats"), P("bmiStats"): _of("BmiStats"), P("exerciseStats"): _of("ExFreqStats"), P("experienceStats"): _of("ExpStats"),
    }, own=True),
    _statistics("AgeStats", "AgeStatistics", {"meanAge": "age_mean_raw", "ageDescription": "age_range_raw", "sdAge": Ref("age_sd_raw", DECIMAL), "minAge": Ref("age_min_raw", DECIMAL), "maxAge": Ref("age_max_raw", DECIMAL)}),
    _statistics("BmiStats", "BMIStatistics", {"meanBMI": "bmi_mean_raw", "bmiDescription": "bmi_range_raw"}),
    _statistics("ExFreqStats", "ExerciseFrequencyStatistics", {"meanExFR": "freq_mean_raw", "minExFR": "freq_min_raw", "maxExFR": "freq_max_raw", "freqUnit": "freq_unit", "freqBase": "freq_base"}),
    _statistics("ExpStats", "YearsOfExperienceStatistics", {"meanYOE": "exp_mean_raw", "expDescription": "exp_range_raw", "expUnit": "exp_unit"}),
    Entity("Sport", SPORT_IRI, (P("Sport"),), {P("sportName"): Ref("sport_name", lang="en"), P("inScheme"): Constant(SPORT + "scheme", "iri")}),
    Entity("Relations", _of("Relations"), (P("Relations"),), {
        **_plain({"degreR": Ref("degree_r_raw", DECIMAL), "degreP": Ref("degree_p_raw", DECIMAL), "signeP": "p_sign", "degreBeta": Ref("degree_beta_raw", DECIMAL), "degreR2": Ref("degree_r2_raw", DECIMAL), "resultatRelation": "relation_direction", "relationDegreeSecondary": "secondary_degree"}),
        P("hasDependentVariable"): VD_IRI, P("hasIndependentVariable"): VI_IRI,
    }, own=True),
    Entity("VariableVD", VD_IRI, (P("VariableDependante"),), {
        **_plain({"VD": "vd_label", "specification": "vd_specification"}), P("refersToVariable"): Template(VOCAB + "{vd}"), P("measure"): Template(TOOLS + "Measure_{vd_measure}"),
    }, own=True),
    Entity("VariableVI", VI_IRI, (P("VariableIndependante"),), {
        **_plain({"VI": "vi_label", "specification": "vi_specification"}), P("refersToVariable"): Template(VOCAB + "{vi}"), P("measure"): Template(TOOLS + "Measure_{vi_measure}"),
    }, own=True),
    Entity("MeasureVD", Template(TOOLS + "Measure_{vd_measure}"), (P("Measure"),), {P("prefLabel"): Ref("vd_measure", lang="en")}),
    Entity("MeasureVI", Template(TOOLS + "Measure_{vi_measure}"), (P("Measure"),), {P("prefLabel"): Ref("vi_measure", lang="en")}),
    Entity("Mediator", Template(VOCAB + "{mediator_name}"), (P("Concept"),), {P("prefLabel"): Ref("mediator_name", lang="en"), P("note"): Template("{mediator_name} (mediator)", "literal", lang="en")}),
    Entity("Moderator", Template(VOCAB + "{moderator}"), (P("Concept"),), {P("prefLabel"): Ref("moderator", lang="en")}),
    Entity("Subgroup", Template(DATA + "Subgroup_{analysis_id}_{subgroup}"), (P("Subgroup"),), _plain({"label": "subgroup"}), own=True),
)
#: Class and the classes above it: a member of the one counts as a member of the other.
SUPERCLASSES = {P("VariableDependante"): P("Variable"), P("VariableIndependante"): P("Variable"), **{P(c): P("Statistics") for c in ("AgeStatistics", "BMIStatistics", "ExerciseFrequencyStatistics", "YearsOfExperienceStatistics")}}


def graph(spark: SparkSession, sf_dir: str, *predicates: str) -> DataFrame:
    """The typed triples of the sheet; with predicates (local names, or the full name of the class predicate) only those."""
    full = {p if ":" in p else P(p) for p in predicates}
    return triples(sheet(spark, sf_dir), ENTITIES, full or None)
