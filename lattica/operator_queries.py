"""Queries of single operators, each with DuckDB SQL, on inputs with ties, diamonds, cycles, dangling nodes and rows that match nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.config import RECALL_AT, Config
from lattica.functions import answers as A
from lattica.functions import json_text as J
from lattica.functions import lexicons as L
from lattica.functions import text as T
from lattica.functions.vectors import l2_normalize
from lattica.operators import capsules as C
from lattica.operators import dag, entities, graph, modelled, retrieval, segmentation
from lattica.plans import models
from lattica.plans.checkpoints import cut, ensure_checkpoint_dir
from lattica.plans.engine import Engine
from lattica.queries import _TOP, _VEC, MENTIONS, PASSAGES, _corpus, _saying, _vector_top, query, read, sql_list
from lattica.sources import readers


def _values(texts: list[str]) -> str:
    return ", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in enumerate(texts))


def _templated(spark, d, texts: list[str]) -> DataFrame:
    """``(n_nationkey, k, t)``: every text with the nation's name at ``{}``."""
    rows = read(spark, d, "nation").select("n_nationkey", "n_name", F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("k", "t"))
    return rows.select("n_nationkey", "k", F.replace("t", F.lit("{}"), F.col("n_name")).alias("t"))


def _templates_sql(texts: list[str]) -> str:
    return f"tpl AS (SELECT n_nationkey, k::INT AS k, replace(t, '{{}}', n_name) AS t FROM nation, (VALUES {_values(texts)}) v(k, t))"


NORM = r"lower(trim(regexp_replace(regexp_replace(trim(coalesce({}, '')), '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g'), '\s+', ' ', 'g')))"

# --- text


@query(f"SELECT conv_id, turn, {NORM.format('text')} AS norm FROM conversations")
def entity_norms(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.normalize_entity("text").alias("norm"))


SURFACES = [
    "{}", "the {}", "He {}", "Professor of {}", "Thomas C. {}", "American {}", "American lower", "German-born {}", "1999", "May 5, 1999", "maybe 5 of 1999", "12345",
    "ab", "it", "a, long surface with a comma that goes on and on {}", "One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve {}", "J. R. Smith", "van der {}", " Éric  Ångström ", "chief of {}", "",
]
_S, _FIRST, _SECOND = "trim(t)", r"lower(string_split_regex(trim(t), '\s+')[1])", r"string_split_regex(trim(t), '\s+')[2]"
_DATE = f"((regexp_matches(lower({_S}), '{'|'.join(L.MONTHS)}') AND regexp_matches(lower({_S}), '\\b\\d{{1,2}}\\b') AND regexp_matches(lower({_S}), '\\b\\d{{4}}\\b')) OR regexp_matches({_S}, '^\\d{{4}}$'))"
_NEXT = rf"({_SECOND} IS NULL OR (regexp_matches({_SECOND}, '\p{{Ll}}') AND NOT regexp_matches({_SECOND}, '\p{{Lu}}')))"
VALID = rf"""(length({_S}) BETWEEN 3 AND 80 AND len(string_split_regex({_S}, '\s+')) <= 12 AND NOT (
  {" OR ".join(f"starts_with(lower({_S}), '{p}')" for p in L.ROLE_PREFIXES)} OR {_DATE} OR regexp_matches({_S}, '^\p{{N}}+$') OR {_FIRST} IN {sql_list(L.PRONOUNS + L.DETERMINERS)}
  OR lower({_S}) IN {sql_list(L.PRONOUNS)} OR (contains({_S}, ',') AND length({_S}) > 40)
  OR (({_FIRST} IN {sql_list(L.DEMONYMS)} OR string_split_regex({_FIRST}, '[-/]')[1] IN {sql_list(L.DEMONYMS)}) AND {_NEXT})))"""
PERSON = rf"(len(string_split_regex({_S}, '\s+')) BETWEEN 2 AND 5 AND regexp_matches(string_split_regex({_S}, '\s+')[1], '^\p{{Lu}}') AND regexp_matches(string_split_regex({_S}, '\s+')[-1], '^\p{{Lu}}'))"
PERSON_KEY = "CASE WHEN " + PERSON + " THEN " + NORM.format(rf"replace(string_split_regex({_S}, '\s+')[1], '.', '') || ' ' || replace(string_split_regex({_S}, '\s+')[-1], '.', '')") + " END"


@query(f"WITH {_templates_sql(SURFACES)} SELECT n_nationkey, k, {VALID} AS valid, {_DATE} AS dated, {PERSON} AS person, {PERSON_KEY} AS person_key FROM tpl")
def surface_rules(spark, d):
    """What may become an entity, what is a date, who is a person and under which key."""
    rows = _templated(spark, d, SURFACES)
    return rows.select(
        "n_nationkey", "k", T.is_valid_entity_surface("t").alias("valid"), T.looks_like_date("t").alias("dated"), T.looks_like_person("t").alias("person"), T.person_key("t").alias("person_key")
    )


NAMES = ["org/{} v1.0", "__{}__", "a b  c", "{}-x_y.z", "***"]


@query(f"WITH {_templates_sql(NAMES)} SELECT n_nationkey, k, regexp_replace(regexp_replace(trim(t), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM tpl")
def safe_names(spark, d):
    return _templated(spark, d, NAMES).select("n_nationkey", "k", T.safe_name("t").alias("safe"))


PLACES = ["Springfield, {}", "Springfield, Illinois", "New York City, New York", "A, B, {}", "Lyon, France", "{}", " Paris , ", "", "Bern, {}, Europe, Earth"]
_PARTS = "list_filter(list_transform(string_split(trim(t), ','), lambda x: trim(x)), lambda x: x <> '')"


@query(
    f"""WITH {_templates_sql(PLACES)}, p AS (SELECT n_nationkey, k, t, {_PARTS} AS x FROM tpl)
    SELECT n_nationkey, k, CASE WHEN len(x) >= 3 THEN x[1] WHEN len(x) = 2 THEN CASE WHEN lower(x[2]) IN {sql_list(L.COUNTRIES)} THEN x[1]
      WHEN lower(x[2]) IN {sql_list(L.US_STATES)} AND starts_with(lower(x[1]), lower(x[2])) AND contains(lower(x[1]), 'city') THEN x[2]
      WHEN lower(x[2]) IN {sql_list(L.US_STATES)} THEN x[1] ELSE x[1] || ', ' || x[2] END ELSE trim(t) END AS place FROM p"""
)
def place_names(spark, d):
    return _templated(spark, d, PLACES).select("n_nationkey", "k", A.normalize_place("t").alias("place"))


#: Question, evidence, and what the rules find, with a nation's name at the braces.
SPANS = [
    ("What is the place of birth of X?", "Some say. X was born in Rome, {}; later he left.", "Rome, {}"),
    ("Where did X die?", "X died in Paris, France. End", "Paris"),
    ("When did X die?", "X died on May 5, 1899; buried {}.", "5 May 1899"),
    ("What is the date of death of X?", "Date of death: 1899-05-05.", "5 May 1899"),
    ("Where did X study?", "X studied at {} College. X works at Y.", "{} College"),
    ("Where does X work?", "Once a professor at {}\nand more", "{}"),
    ("Who is X?", "X was born in Rome, {}.", ""),
    ("Where was X born?", "Nothing is known of {}.", ""),
]


@query(
    "SELECT n_nationkey, k::INT AS k, replace(t, '{}', n_name) AS span FROM nation, (VALUES " + _values([s for _, _, s in SPANS]) + ") v(k, t)"
)
def evidence_spans(spark, d):
    """Every rule of spans: births, deaths, dates, studies, work, and nothing."""
    q, e = (_templated(spark, d, [s[i] for s in SPANS]).withColumnRenamed("t", c) for i, c in ((0, "q"), (1, "e")))
    return q.join(e, ["n_nationkey", "k"]).select("n_nationkey", "k", A.extract_span("q", "e").alias("span"))


#: Question, raw answer, short answer.
SHORT = [
    ("Which is older, {} or Rome?", "Answer: I think {} is.", "{}"),
    ("Who out of {} and Bob?", "It is Bob", "Bob"),
    ("Which lies between {} and Bob?", "neither one", ""),
    ("Are they both in {}?", "The answer is: Yes, both.", "yes"),
    ("What nationality is X?", "USA", "America"),
    ("What nationality is X?", "Germany", "Germany"),
    ("When was it?", "final answer is - March 3rd, 1901.", "3 March 1901"),
    ("Where was X born?", "Springfield, Illinois", "Springfield"),
    ("Where was X born?", "Springfield, {}", "Springfield, {}"),
    ("What is it?", '"{} (a nation)"\nMore lines', "{}"),
    ("What is it?", "", ""),
]


@query(
    "SELECT n_nationkey, k::INT AS k, replace(t, '{}', n_name) AS short FROM nation, (VALUES " + _values([s[2] if k != 2 else "neither one" for k, s in enumerate(SHORT)]) + ") v(k, t)"
)
def short_answers(spark, d):
    """The rules of answers: options in three wordings, closed questions, nationalities, dates, cities, bare names."""
    q, e = (_templated(spark, d, [s[i] for s in SHORT]).withColumnRenamed("t", c) for i, c in ((0, "q"), (1, "e")))
    return q.join(e, ["n_nationkey", "k"]).select("n_nationkey", "k", A.postprocess_answer("e", "q").alias("short"))


#: A model's text and the first number that can be read out of it.
SELECTED = [
    ('{"selected": [2, 0]}', "2,0"), ('Sure!\n```json\n{"selected": [1,]}\n```', "1"), ("{'selected': [3], 'why': None}", "3"), ("no json {}", None), ('{"other": 1}', None), ('x {"selected": []} y', ""),
]


@query(
    "SELECT n_nationkey, k::INT AS k, t AS picks FROM nation, (VALUES "
    + ", ".join(f"({i}, {'NULL' if s is None else repr(s)})" for i, (_, s) in enumerate(SELECTED))
    + ") v(k, t)"
)
def selected_numbers(spark, d):
    """Choices of a reranking model, in JSON that is more or less right."""
    rows = read(spark, d, "nation").select("n_nationkey", F.posexplode(F.array(*[F.lit(t) for t, _ in SELECTED])).alias("k", "t"))
    return rows.select("n_nationkey", "k", F.array_join(F.transform(J.read_selected("t"), lambda x: x.cast("string")), ",").alias("picks"))


EDGES = ['{"source": "a", "target": "b"}', '{"from": "a", "to": "b"}', '{"src": "a", "dst": "b"}', '["a", "b"]', '{"source": "a"}']


@query("SELECT n_nationkey, k::INT AS k, 'a' AS src, CASE WHEN k < 4 THEN 'b' END AS dst FROM nation, (VALUES (0), (1), (2), (3), (4)) v(k)")
def edge_forms(spark, d):
    """Edges of a question graph under the names and forms that models use."""
    rows = read(spark, d, "nation").select("n_nationkey", F.posexplode(F.array(*[F.lit(t) for t in EDGES])).alias("k", "e"))
    got = J.read_dag(F.concat(F.lit('{"nodes": [{"id": "a"}], "edges": ['), "e", F.lit("]}")))["edges"][0]
    return rows.select("n_nationkey", "k", got["source"].alias("src"), got["target"].alias("dst"))


@query(
    """SELECT conv_id, count(*)::BIGINT AS places, string_agg(p || ':' || s || ':' || q, '|' ORDER BY p, s) AS listed FROM (
      SELECT conv_id, role AS p, turn % 3 AS s, min(md5(coalesce(text, ''))) AS q FROM conversations GROUP BY ALL) GROUP BY conv_id"""
)
def provenance_places(spark, d):
    """Turns as provenance: one row of each place, the smallest quote."""
    place = F.struct(F.lit("D").alias("doc_id"), F.col("conv_id").alias("doc_idx"), F.col("role").alias("passage_id"), (F.col("turn") % 3).cast("int").alias("sent_id"), F.md5(F.coalesce("text", F.lit(""))).alias("quote"))
    made = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(place).alias("p")).select("conv_id", J.distinct_provenance("p").alias("p"))
    shown = F.transform("p", lambda x: F.concat_ws(":", x["passage_id"], x["sent_id"].cast("string"), x["quote"]))
    return made.select("conv_id", F.size("p").cast("long").alias("places"), F.array_join(shown, "|").alias("listed"))


TITLES = ["List of {}", "{} (disambiguation)", "Index of the {}", "{} (list)", "The {}", "of the", "", "{}"]
SNIPPETS = ["", "", "", "It may refer to many", "It may also refer to more", "", "any", "plain"]
_TOK = r"regexp_extract_all(lower(t), '[a-z0-9]+')"


@query(
    f"""WITH {_templates_sql(TITLES)}, s AS (SELECT *, lower(trim(t)) AS l, list_extract({SNIPPETS!r}, k + 1) AS sn, {_TOK} AS w FROM tpl),
    r AS (SELECT *, CASE WHEN len(w) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(w, lambda x: x IN {sql_list(L.TITLE_STOPWORDS)}))::DOUBLE / len(w) END AS stop FROM s)
    SELECT n_nationkey, k, round(CASE WHEN l = '' THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.7 * (1 - (n_nationkey / 24.0)) + 0.3 * stop
      + CASE WHEN starts_with(l, 'list of ') OR starts_with(l, 'index of ') OR ends_with(l, ' (list)') THEN 0.25 ELSE 0 END
      + CASE WHEN contains(l, '(disambiguation)') OR contains(lower(sn), 'may refer to') OR contains(lower(sn), 'may also refer to') THEN 0.4 ELSE 0 END)) END, 6) AS genericness FROM r"""
)
def vague_titles(spark, d):
    """Lists, indexes, disambiguations, titles of stop words only, empty ones, and what their snippets say."""
    rows = _templated(spark, d, TITLES).withColumn("snippet", F.get(F.array(*[F.lit(x) for x in SNIPPETS]), F.col("k")))
    score = T.genericness("t", F.col("n_nationkey").cast("double"), F.lit(0.0), F.lit(24.0), "snippet")
    return rows.select("n_nationkey", "k", F.round(score, 6).alias("genericness"))


# --- vectors and models


@query(
    f"""WITH {_VEC}, u AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM v), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL)
    SELECT label, i::INT AS i, round(x, 6) AS mean, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS unit FROM m"""
)
def label_centroids(spark, d):
    """Mean vectors of the labels, pooled as arrays and summed by dimension, and their directions."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("capsule_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    means = v.groupBy("label").agg(F.collect_list("embedding").alias("vs")).select("label", F.posexplode(models.pooled("vs")).alias("i", "mean"))
    units = C.centroids(v.drop("label"), v.select("capsule_id", F.col("label").alias("cluster"))).select(F.col("cluster").alias("label"), F.posexplode("embedding").alias("i", "unit"))
    return means.join(units, ["label", "i"]).select("label", "i", F.round("mean", 6).alias("mean"), F.round("unit", 6).alias("unit"))


@query(
    """WITH c AS (SELECT item_id, unnest([0, 1, 2]) AS i, unnest([length('q: ' || text) - length(replace('q: ' || text, 'a', '')), length('q: ' || text) - length(replace('q: ' || text, 'e', '')),
      length('q: ' || text) - length(replace('q: ' || text, 'q', ''))]) AS n FROM benchmark)
    SELECT item_id, i::INT AS i, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS x FROM c"""
)
def embedder_seam(spark, d):
    """An embedder that is plugged in by name, with an instruction before its texts."""
    models.EMBEDDERS["letters"] = lambda texts: texts.map(lambda t: [t.count(c) for c in "aeq"])
    made = models.encode(read(spark, d, "benchmark"), "item_id", "text", "my-Letters-v1", instruction="q: ")
    return made.select("item_id", F.posexplode("embedding").alias("i", "x")).select("item_id", "i", F.round("x", 6).alias("x"))


def _folder(spark, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{spark.sql('SELECT uuid()').first()[0]}"


@query("SELECT count(DISTINCT coalesce(text, ''))::BIGINT AS kept, count(DISTINCT coalesce(text, ''))::BIGINT AS kept_again, count(*)::BIGINT AS answered FROM conversations")
def answers_kept(spark, d):
    """Answers live between runs: the second run asks and adds nothing."""
    rows = read(spark, d, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("text"))
    cache = models.Cached(lambda prompts: prompts.str.upper() + "!", _folder(spark, "answers"))
    models.ask(rows, F.col("text"), cache, "said")
    kept = spark.read.parquet(cache.folder).count()
    again = models.ask(rows, F.col("text"), models.Cached(lambda prompts: prompts.map(lambda _: None), cache.folder), "said")
    n = again.where(F.col("said") == F.concat(F.upper("text"), F.lit("!")))
    return n.agg(F.lit(kept).cast("long").alias("kept"), F.lit(spark.read.parquet(cache.folder).count()).cast("long").alias("kept_again"), F.count("*").alias("answered"))


# --- entities and capsules

CAPS = rf"""{PASSAGES},
caps AS (SELECT printf('C_%08d', row_number() OVER (ORDER BY doc_idx, passage_id, s.pos) - 1) AS doc_id, doc_idx, passage_id, (s.pos - sent_start)::INT AS sent_id, s.sentence AS text
  FROM pass JOIN sent s ON s.doc_id = doc_idx AND s.pos >= sent_start AND s.pos < least(stop, sent_start + 6)),
{MENTIONS.replace("FROM documents", "FROM caps")}"""
ENTITIES = rf"""{CAPS},
said AS (SELECT m AS t, 0 AS title FROM kept UNION ALL SELECT split_part(coalesce(text, ''), chr(10), 1), 1 FROM documents),
counted AS (SELECT trim(t) AS surface, count(*)::BIGINT AS freq, max(title) AS is_title FROM said WHERE {VALID} GROUP BY trim(t)),
surf AS (SELECT * FROM counted WHERE regexp_matches(surface, '\p{{Lu}}') OR is_title = 1 OR (len(string_split_regex(surface, '\s+')) <= 4 AND freq >= 2)),
norms AS (SELECT surface, freq, is_title, {NORM.format("surface")} AS norm, {PERSON_KEY.replace("trim(t)", "trim(surface)")} AS person FROM surf),
shared AS (SELECT person, min(norm) AS low FROM norms WHERE norm <> '' AND person IS NOT NULL GROUP BY person HAVING min(norm) <> max(norm)),
ties AS (SELECT DISTINCT norm AS x, low AS y FROM norms JOIN shared USING (person) WHERE norm <> low AND norm <> ''),
both_ AS (SELECT x, y FROM ties UNION SELECT y, x FROM ties),
reach AS (SELECT x AS node, x AS lab FROM both_ UNION SELECT b.y, r.lab FROM reach r JOIN both_ b ON b.x = r.node AND r.lab < b.y),
comp AS (SELECT node, min(lab) AS comp FROM reach GROUP BY node),
clus AS (SELECT n.*, coalesce(comp, norm) AS cluster FROM norms n LEFT JOIN comp ON node = norm WHERE norm <> ''),
picked AS (SELECT cluster, surface AS name FROM clus QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY is_title DESC, CASE WHEN is_title = 1 THEN 0 ELSE -freq END,
  CASE WHEN is_title = 1 THEN 0 ELSE length(surface) END, surface) = 1),
ents AS (SELECT printf('E_%07d', row_number() OVER (ORDER BY sum(freq) DESC, lower(name), name) - 1) AS entity_id, name AS canonical_name, list_sort(list(DISTINCT surface)) AS aliases, sum(freq)::BIGINT AS freq
  FROM clus JOIN picked USING (cluster) GROUP BY cluster, name),
alias AS (SELECT norm, min(entity_id) AS entity_id FROM (SELECT entity_id, {NORM.format("u")} AS norm FROM (SELECT entity_id, unnest(aliases) AS u FROM ents)) WHERE norm <> '' GROUP BY norm),
capent AS (SELECT k.doc_id AS capsule_id, a.entity_id, k.m, k.i FROM kept k JOIN alias a ON a.norm = {NORM.format("k.m")})"""


@query(f"WITH RECURSIVE {ENTITIES} SELECT entity_id, canonical_name, array_to_string(aliases, '|') AS aliases, freq FROM ents")
def entity_table(spark, d):
    """Canonical entities of the whole corpus."""
    _, ents, _ = _attached(spark, d)
    return ents.select("entity_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "freq")


@query(
    f"""WITH RECURSIVE {ENTITIES} SELECT c.doc_id AS capsule_id, coalesce(string_agg(DISTINCT e.entity_id, ',' ORDER BY e.entity_id), '') AS entity_ids,
    coalesce((SELECT string_agg(k.m || '=' || coalesce(x.entity_id, ''), '|' ORDER BY k.i) FROM kept k LEFT JOIN capent x ON x.capsule_id = k.doc_id AND x.m = k.m WHERE k.doc_id = c.doc_id), '') AS arguments
    FROM caps c LEFT JOIN capent e ON e.capsule_id = c.doc_id GROUP BY c.doc_id"""
)
def attached_entities(spark, d):
    """Capsules with the entities of their arguments."""
    shown = F.transform("arguments", lambda a: F.concat(a["surface"], F.lit("="), F.coalesce(a["entity_id"], F.lit(""))))
    return _attached(spark, d)[2].select("capsule_id", F.array_join("entity_ids", ",").alias("entity_ids"), F.array_join(shown, "|").alias("arguments"))


def _attached(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus = _corpus(spark, d)
    p = cut(segmentation.passages(corpus))
    caps = cut(segmentation.sentence_capsules(p))
    ents = cut(entities.entities(entities.entity_clusters(entities.surface_counts(caps, corpus.select("title")))))
    return p, ents, cut(entities.attach_entities(caps, entities.alias_index(ents)))


@query(
    f"""WITH RECURSIVE {ENTITIES}, canon AS (SELECT doc_id AS canonical_id, doc_idx, passage_id FROM caps)
    SELECT DISTINCT * FROM (SELECT 'P:' || passage_id AS src, 'D:' || doc_idx AS dst, 'in_doc' AS type, 0.05::DOUBLE AS cost FROM pass
      UNION ALL SELECT 'C:' || canonical_id, 'P:' || passage_id, 'in_passage', 0.06 FROM canon UNION ALL SELECT 'C:' || capsule_id, 'E:' || entity_id, 'mentions', 0.08 FROM capent)"""
)
def evidence_edges(spark, d):
    """Edges of passages, of all capsules as nodes of their own, and of their entities."""
    p, _, caps = _attached(spark, d)
    canon = caps.select(F.col("capsule_id").alias("canonical_id"), F.array("passage_id").alias("passage_ids"), "entity_ids")
    return graph.evidence_edges(p, canon)


@query(
    f"""WITH RECURSIVE {ENTITIES}, v AS (
      SELECT 'doc_to_passages' AS view, doc_idx::VARCHAR AS k, passage_id AS x FROM pass UNION SELECT 'passage_to_doc', passage_id, doc_idx::VARCHAR FROM pass
      UNION SELECT 'passage_to_canonical', passage_id, doc_id FROM caps UNION SELECT 'canonical_to_passages', doc_id, passage_id FROM caps
      UNION SELECT 'entity_to_canonical', entity_id, capsule_id FROM capent UNION SELECT 'alias_to_entity', a, entity_id FROM (SELECT entity_id, unnest(aliases) AS a FROM ents))
    SELECT view, k, string_agg(x, ',' ORDER BY x) AS xs FROM v GROUP BY view, k"""
)
def struct_index(spark, d):
    """All six inverted views over the corpus, with every capsule as a node of its own."""
    p, ents, caps = _attached(spark, d)
    canon = caps.select(F.col("capsule_id").alias("canonical_id"), F.array("passage_id").alias("passage_ids"), "entity_ids")
    whole = None
    for name, df in C.struct_index(p, canon, ents).items():
        key, value = df.columns
        held = F.array_join(F.transform(value, lambda x: x.cast("string")), ",") if dict(df.dtypes)[value].startswith("array") else F.col(value).cast("string")
        part = df.select(F.lit(name).alias("view"), F.col(key).cast("string").alias("k"), held.alias("xs"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query(
    f"""WITH RECURSIVE {ENTITIES},
    cw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM caps),
    cc AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM cw GROUP BY ALL),
    cv AS (SELECT doc_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM cc),
    ce AS (SELECT DISTINCT capsule_id, entity_id FROM capent), es AS (SELECT capsule_id, string_agg(entity_id, ',' ORDER BY entity_id) AS es FROM ce GROUP BY capsule_id),
    cop AS (SELECT c.doc_id AS capsule_id, min(c.doc_id) OVER (PARTITION BY c.text, es.es) AS first FROM caps c JOIN es ON es.capsule_id = c.doc_id),
    cand AS (SELECT DISTINCT a.capsule_id AS a, b.capsule_id AS b FROM ce a JOIN ce b ON a.entity_id = b.entity_id AND a.capsule_id < b.capsule_id
      JOIN cop x ON x.capsule_id = a.capsule_id AND x.first = a.capsule_id JOIN cop y ON y.capsule_id = b.capsule_id AND y.first = b.capsule_id),
    sims AS (SELECT cand.a, cand.b FROM cand JOIN cv x ON x.doc_id = cand.a JOIN cv y ON y.doc_id = cand.b AND y.b = x.b GROUP BY cand.a, cand.b HAVING round(sum(x.x * y.x), 9) >= 0.88),
    lk AS (SELECT a AS x, b AS y FROM sims UNION SELECT capsule_id, first FROM cop WHERE capsule_id <> first), bw AS (SELECT x, y FROM lk UNION SELECT y, x FROM lk),
    rr AS (SELECT x AS node, x AS lab FROM bw UNION SELECT bw.y, rr.lab FROM rr JOIN bw ON bw.x = rr.node AND rr.lab < bw.y), cl AS (SELECT node, min(lab) AS cluster FROM rr GROUP BY node),
    mem AS (SELECT c.doc_id AS capsule_id, c.text, c.passage_id, c.doc_idx, c.sent_id, coalesce(cluster, c.doc_id) AS cluster FROM caps c LEFT JOIN cl ON node = c.doc_id)
    SELECT printf('CC_%07d', substr(cluster, 3, 8)::INT) AS canonical_id, arg_min(text, capsule_id) AS text, string_agg(capsule_id, ',' ORDER BY capsule_id) AS member_ids, count(*)::BIGINT AS freq,
      count(DISTINCT passage_id || ':' || sent_id)::BIGINT AS num_provenance, coalesce((SELECT string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) FROM ce JOIN mem m2 ON m2.capsule_id = ce.capsule_id WHERE m2.cluster = mem.cluster), '') AS entity_ids
    FROM mem GROUP BY cluster"""
)
def canonical_capsules(spark, d):
    """Capsules of the whole corpus merged by shared entities and similarity."""
    _, _, caps = _attached(spark, d)
    caps = cut(caps.join(models.encode(caps, "capsule_id", "text"), "capsule_id"))
    made = C.canonical_capsules(caps, cut(C.capsule_clusters(caps)))
    return made.select("canonical_id", "text", F.array_join("entity_ids", ",").alias("entity_ids"), F.array_join("member_ids", ",").alias("member_ids"), "freq", "num_provenance")


@query(
    rf"""WITH RECURSIVE {PASSAGES}, x AS (SELECT passage_id, (s.pos - sent_start)::INT AS sent_id, length(s.sentence) AS n, s.pos FROM pass JOIN sent s ON s.doc_id = doc_idx AND s.pos >= sent_start AND s.pos < stop),
    y AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY passage_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM x)
    SELECT passage_id, sent_id, start, (start + n)::INT AS stop FROM y"""
)
def sentence_spans(spark, d):
    return segmentation.sentence_spans(segmentation.passages(_corpus(spark, d)))


_FACTS = "f AS (SELECT printf('C_%08d', vec_id) AS id, e, [label::VARCHAR, 'v' || vec_id % 5] AS ents, CASE WHEN vec_id % 2 = 0 THEN '+' ELSE '-' END AS pol, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'p' || vec_id % 3 END AS pred, 'T' || vec_id % 20 AS text FROM v)"


def _facts(spark, d) -> DataFrame:
    v = F.col("vec_id")
    return read(spark, d, "embeddings").select(
        F.format_string("C_%08d", v).alias("capsule_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.array(F.col("label").cast("string"), F.concat(F.lit("v"), (v % 5).cast("string"))).alias("entity_ids"),
        F.when(v % 2 == 0, "+").otherwise("-").alias("polarity"), F.when(v % 3 == 0, "").otherwise(F.concat(F.lit("p"), (v % 3).cast("string"))).alias("predicate"), F.concat(F.lit("T"), (v % 20).cast("string")).alias("text"),
    )


@query(
    f"""WITH {_VEC}, {_FACTS} SELECT a.id AS a, b.id AS b, round(list_inner_product(a.e, b.e), 6) AS sim FROM f a JOIN f b ON a.id < b.id AND a.pol = b.pol AND len(list_intersect(a.ents, b.ents)) > 0
    WHERE list_inner_product(a.e, b.e) >= CASE WHEN a.pred = b.pred OR a.pred = '' OR b.pred = '' THEN 0.2 ELSE 0.3 END"""
)
def similar_capsules(spark, d):
    """Pairs that share an entity and agree in polarity; different predicates need a higher similarity."""
    return C.similar_pairs(_facts(spark, d), Config(merge_threshold=0.2, predicate_free_threshold=0.3)).select("a", "b", F.round("sim", 6).alias("sim"))


@query(
    f"""WITH {_VEC}, {_FACTS}, p AS (SELECT a.id AS a, b.id AS b, a.text = b.text AS same, list_inner_product(a.e, b.e) AS sim FROM f a JOIN f b ON a.id < b.id AND len(list_intersect(a.ents, b.ents)) > 0 WHERE list_inner_product(a.e, b.e) >= 0.1),
    j AS (SELECT * FROM p WHERE NOT same ORDER BY round(sim, 9) DESC, a, b LIMIT 70)
    SELECT 'C:' || a AS src, 'C:' || b AS dst, CASE WHEN same THEN 'entails' ELSE 'contradicts' END AS type, CASE WHEN same THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS cost,
      CASE WHEN same THEN 'equivalent' ELSE 'contradicts' END AS label, CASE WHEN same THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM (SELECT * FROM p WHERE same UNION ALL SELECT * FROM j)"""
)
def entailment_edges(spark, d):
    """All pairs of equal texts, and the 70 most similar others (the budget of calls), which the model holds for contradictions."""
    made = modelled.entailment_edges(_facts(spark, d).withColumnRenamed("capsule_id", "canonical_id"), _saying('{"label": " Contradicts", "confidence": 0.7}'), Config(entails_min_sim=0.1, nli_max_pairs=70))
    return made.select("src", "dst", "type", "cost", "label", "confidence")


@query(
    f"""WITH {_VEC}, k AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e), 9) AS sim FROM v a, v b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) <= 8)
    SELECT DISTINCT least('C:' || a, 'C:' || b) AS src, greatest('C:' || a, 'C:' || b) AS dst, round(sim, 4) AS sim FROM k WHERE a <> b AND sim >= 0.25"""
)
def sim_edges(spark, d):
    """Similarity edges between nodes, none of which shares a block: each counts among its own nearest."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("canonical_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return retrieval.sim_edges(v, Config(sim_edge_topk=8, sim_edge_threshold=0.25)).select("src", "dst", F.round("sim", 4).alias("sim"))


# --- ranking

_NEAR = f"{_TOP}, n AS (SELECT query_id AS qid, vec_id, label, sim, rank FROM r WHERE rank <= 40)"


def _near(spark, d, k: int = 40) -> DataFrame:
    return _vector_top(spark, d, k).withColumnRenamed("query_id", "qid").join(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id")


@query(
    f"""WITH {_NEAR}, p AS (SELECT qid, vec_id, sim + CASE WHEN label = qid / 100 % 10 OR vec_id % 7 = 3 AND qid <> 100 THEN 0.05 ELSE 0 END AS prize FROM n WHERE rank <= 20)
    SELECT qid, vec_id::VARCHAR AS canonical_id, round(prize, 6) AS prize, (row_number() OVER (PARTITION BY qid ORDER BY prize DESC, vec_id::VARCHAR))::INT AS rank FROM p"""
)
def candidate_prizes(spark, d):
    """Candidates with a bonus for a shared entity; one question asks for no entity of the second kind."""
    n = _near(spark, d).where("rank <= 20")
    c = n.select("qid", F.lit("q1").alias("gid"), F.col("vec_id").cast("string").alias("canonical_id"), "sim")
    own = n.select(F.col("vec_id").cast("string").alias("canonical_id"), F.array(F.concat(F.lit("l"), F.col("label").cast("string")), F.concat(F.lit("m"), (F.col("vec_id") % 7).cast("string"))).alias("entity_ids")).distinct()
    first = F.concat(F.lit("l"), (F.floor(F.col("qid") / 100) % 10).cast("string"))
    asked = n.select("qid").distinct().select("qid", F.lit("q1").alias("gid"), F.when(F.col("qid") == 100, F.array(first)).otherwise(F.array(first, F.lit("m3"))).alias("asked"))
    return retrieval.prizes(c, own, asked).select("qid", "canonical_id", F.round("prize", 6).alias("prize"), "rank")


@query(
    f"""WITH {_NEAR}, p AS (SELECT qid, vec_id, sim + 2.0::DOUBLE * CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE / (60 + vec_id % 13) ELSE 0 END AS prize FROM n)
    SELECT qid, vec_id::VARCHAR AS canonical_id, round(prize, 6) AS prize, (row_number() OVER (PARTITION BY qid ORDER BY prize DESC, vec_id::VARCHAR))::INT AS rank FROM p"""
)
def boosted_prizes(spark, d):
    """Prizes raised by ranks of propagation, which every other candidate has."""
    n = _near(spark, d)
    c = n.select("qid", F.lit("q1").alias("gid"), F.col("vec_id").cast("string").alias("canonical_id"), F.col("sim").alias("prize"))
    fused = n.where("vec_id % 2 = 0").select("qid", F.col("vec_id").cast("string").alias("canonical_id"), (F.lit(1.0) / (60 + F.col("vec_id") % 13)).alias("rrf"))
    return retrieval.boosted(c, fused).select("qid", "canonical_id", F.round("prize", 6).alias("prize"), "rank")


@query(
    f"""WITH {_NEAR}, c AS (SELECT *, CASE WHEN rank % 2 = 1 THEN 'q1' ELSE 'q2' END AS gid FROM n WHERE rank <= 24 AND NOT (rank % 2 = 0 AND qid = 200)),
    w AS (SELECT a.qid, a.vec_id::VARCHAR AS a, b.vec_id::VARCHAR AS b, a.sim + 0.08 + coalesce(b.sim + CASE WHEN b.label % 3 = a.label % 3 THEN 0.08 ELSE -0.04 END + CASE WHEN b.vec_id % 5 = a.vec_id % 5 THEN -0.03 ELSE 0.08 END, 0) AS score
      FROM (SELECT * FROM c WHERE gid = 'q1') a LEFT JOIN (SELECT * FROM c WHERE gid = 'q2') b ON a.qid = b.qid),
    best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, a, b) = 1)
    SELECT qid, 'q1' AS gid, a AS canonical_id, round(score, 6) AS score FROM best UNION ALL SELECT qid, 'q2', b, round(score, 6) FROM best"""
)
def assigned_capsules(spark, d):
    """One capsule for each of two groups, the second depending on the first; one question's second group has no candidate."""
    n = _near(spark, d).where("rank <= 24")
    gid = F.when(F.col("rank") % 2 == 1, "q1").otherwise("q2")
    v = F.col("vec_id")
    c = n.select("qid", gid.alias("gid"), v.cast("string").alias("canonical_id"), F.col("sim").alias("prize"), F.ceil(F.col("rank") / 2).cast("int").alias("rank"), F.array((F.col("label") % 3).cast("string")).alias("entity_ids"), F.array(v % 5).alias("doc_idxs"))
    c = c.where("NOT (gid = 'q2' AND qid = 200)")
    qs = n.select("qid").distinct()
    order = qs.select("qid", F.explode(F.array(*[F.struct(F.lit(g).alias("gid"), F.lit(i).alias("level"), F.lit(i).alias("pos")) for i, g in enumerate(("q1", "q2"))])).alias("o")).select("qid", "o.*")
    above = qs.select("qid", F.lit("q2").alias("child"), F.lit("q1").alias("parent"))
    return retrieval.beam_assign(c, order, above).select("qid", "gid", "canonical_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_NEAR} SELECT qid, vec_id AS doc_idx, round(greatest(CASE WHEN rank BETWEEN 10 AND 30 THEN sim * 1.1 - 0.02 ELSE 0 END, 0.9 * greatest(0, CASE WHEN rank <= 20 THEN sim ELSE 0 END))
      + 5.0 * (CASE WHEN rank <= 15 THEN 1.0::DOUBLE / (60 + rank) ELSE 0 END + CASE WHEN rank >= 25 THEN 1.0::DOUBLE / (36 + rank) ELSE 0 END), 6) AS score FROM n"""
)
def document_scores(spark, d):
    """Four signals, each on some of the documents."""
    n = _near(spark, d).withColumnRenamed("vec_id", "doc_idx")
    parts = [n.where("rank <= 20"), n.where("rank BETWEEN 10 AND 30").withColumn("prize", F.col("sim") * 1.1 - 0.02), n.where("rank <= 15").withColumn("rrf", 1.0 / (60 + F.col("rank"))), n.where("rank >= 25").withColumn("rrf", 1.0 / (36 + F.col("rank")))]
    return retrieval.doc_scores(*parts).select("qid", "doc_idx", F.round("score", 6).alias("score"))


_TITLED = f"""t AS (SELECT c_custkey AS doc_idx, 'The Title ' || (c_custkey % 700) AS title, (c_custkey % 10) / 10.0::DOUBLE AS g FROM customer), ti AS (SELECT {NORM.format('title')} AS norm, min(doc_idx) AS doc_idx FROM t GROUP BY 1),
sc AS (SELECT doc_idx % 5 AS qid, doc_idx, (doc_idx % 11) / 10.0::DOUBLE AS score FROM t WHERE doc_idx % 3 = 0)"""


def _titles(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("c_custkey")
    docs = read(spark, d, "customer").select(key.alias("doc_idx"), F.concat(F.lit("The Title "), (key % 700).cast("string")).alias("title"), ((key % 10) / 10.0).alias("genericness"))
    scores = docs.where("doc_idx % 3 = 0").select((F.col("doc_idx") % 5).alias("qid"), "doc_idx", ((F.col("doc_idx") % 11) / 10.0).alias("score"))
    return docs, scores, docs.select("doc_idx", "genericness")


@query(f"WITH {_TITLED} SELECT norm, doc_idx FROM ti")
def title_index(spark, d):
    """The first document of each title; several have the same."""
    return retrieval.title_index(_titles(spark, d)[0])


@query(
    f"""WITH {_TITLED}, e AS (SELECT q.qid, 'E' || (q.qid * 100 + k) AS entity_id, 'the title ' || (k * 13 + q.qid) AS norm, (k % 7) / 10.0::DOUBLE AS score FROM (SELECT DISTINCT qid FROM sc) q, range(60) x(k)),
    top AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity_id) <= 25),
    b AS (SELECT top.qid, ti.doc_idx, 0.6 * sum(top.score) AS bonus FROM top JOIN ti USING (norm) JOIN t ON t.doc_idx = ti.doc_idx AND g < 0.85 GROUP BY ALL),
    j AS (SELECT coalesce(sc.qid, b.qid) AS qid, coalesce(sc.doc_idx, b.doc_idx) AS doc_idx, coalesce(score, 0) + coalesce(bonus, 0) AS score FROM sc FULL JOIN b ON b.qid = sc.qid AND b.doc_idx = sc.doc_idx)
    SELECT qid, j.doc_idx, round(j.score - CASE WHEN g >= 0.85 THEN 0.35 * (g - 0.85) / 0.15 ELSE 0 END, 6) AS score FROM j JOIN t ON t.doc_idx = j.doc_idx"""
)
def title_jumps(spark, d):
    """Documents named by the strongest entities come up, also ones without a score; generic titles go down."""
    docs, scores, generic = _titles(spark, d)
    k = F.col("k")
    e = scores.select("qid").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(59)))).select("qid", F.concat(F.lit("E"), (F.col("qid") * 100 + k).cast("string")).alias("entity_id"), F.concat(F.lit("the title "), (k * 13 + F.col("qid")).cast("string")).alias("norm"), ((k % 7) / 10.0).alias("score"))
    jumped = retrieval.title_jump(scores, e, retrieval.title_index(docs), generic)
    return retrieval.generic_penalty(jumped, generic).select("qid", "doc_idx", F.round("score", 6).alias("score"))


_SAID = "mt AS (SELECT c_custkey AS doc_idx, 'Title' || chr(97 + (c_custkey % 26)::INT) || chr(97 + (c_custkey // 26 % 26)::INT) || chr(97 + (c_custkey // 676)::INT) AS title, (c_custkey % 10) / 10.0::DOUBLE AS g FROM customer), ms AS (SELECT doc_idx % 5 AS qid, doc_idx, (doc_idx % 11) / 10.0::DOUBLE AS score FROM mt WHERE doc_idx % 3 = 0)"


@query(
    f"""WITH {_SAID}, s AS (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx) <= 2),
    m AS (SELECT s.qid, s.doc_idx AS seed, s.score, unnest([s.doc_idx + 1, s.doc_idx + 3, s.doc_idx]) AS doc_idx FROM s WHERE s.score > 0),
    b AS (SELECT m.qid, m.doc_idx, 0.35 * sum(m.score) AS bonus FROM m JOIN mt ON mt.doc_idx = m.doc_idx AND g < 0.85 WHERE m.doc_idx <> m.seed GROUP BY ALL)
    SELECT coalesce(ms.qid, b.qid) AS qid, coalesce(ms.doc_idx, b.doc_idx) AS doc_idx, round(coalesce(score, 0) + coalesce(bonus, 0), 6) AS score FROM ms FULL JOIN b ON b.qid = ms.qid AND b.doc_idx = ms.doc_idx"""
)
def mention_jumps(spark, d):
    """Titles that the best passages of the first documents mention come up; a document's mention of itself counts nothing."""
    key = F.col("c_custkey")
    letter = lambda x: F.chr(97 + x)
    name = lambda k: F.concat(F.lit("Title"), letter(k % 26), letter(F.floor(k / 26) % 26), letter(F.floor(k / 676)))
    docs = read(spark, d, "customer").select(key.alias("doc_idx"), name(key).alias("title"), ((key % 10) / 10.0).alias("genericness"), F.concat(F.lit("P"), key.cast("string")).alias("passage_id"), F.concat(F.lit("so says "), name(key + 1), F.lit(" and "), name(key + 3), F.lit(", not "), name(key), F.lit(".")).alias("text"))
    scores = docs.where("doc_idx % 3 = 0").select((F.col("doc_idx") % 5).alias("qid"), "doc_idx", ((F.col("doc_idx") % 11) / 10.0).alias("score"))
    best = scores.join(docs, "doc_idx").select("qid", "doc_idx", "passage_id")
    made = retrieval.mention_jump(scores, best, docs, retrieval.title_index(docs), docs.select("doc_idx", "genericness"))
    return made.select("qid", "doc_idx", F.round("score", 6).alias("score"))


@query(
    f"""WITH RECURSIVE {_NEAR}, g AS (SELECT qid, vec_id AS d, sim AS score, 'g' || label % 4 AS gid FROM n), every AS (SELECT qid, list(DISTINCT gid) AS gs FROM g GROUP BY qid),
    f AS (SELECT g.*, gs FROM g JOIN every USING (qid) QUALIFY row_number() OVER (PARTITION BY g.qid ORDER BY score DESC, d) = 1),
    c AS (SELECT qid, [d] AS chosen, list_filter(gs, lambda x: x <> gid) AS rest FROM f
      UNION ALL (SELECT c.qid, list_append(c.chosen, g.d), list_filter(c.rest, lambda x: x <> g.gid) FROM c JOIN g ON g.qid = c.qid AND NOT list_contains(c.chosen, g.d) WHERE len(c.rest) > 0 AND len(c.chosen) < 5
        QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY g.score + CASE WHEN list_contains(c.rest, g.gid) THEN 0.06 ELSE 0 END DESC, g.score DESC, g.d) = 1)),
    l AS (SELECT qid, arg_max(chosen, len(chosen)) AS chosen FROM c GROUP BY qid)
    SELECT g.qid, d AS doc_idx, (row_number() OVER (PARTITION BY g.qid ORDER BY CASE WHEN list_contains(chosen, d) THEN list_position(chosen, d) ELSE 1000 END, score DESC, d))::INT AS rank FROM g JOIN l ON l.qid = g.qid"""
)
def diversified_documents(spark, d):
    """The best first, then a few that cover further groups, then by score."""
    n = _near(spark, d).withColumnRenamed("vec_id", "doc_idx")
    covers = n.select("qid", "doc_idx", F.concat(F.lit("g"), (F.col("label") % 4).cast("string")).alias("gid"))
    return retrieval.diversified(n.select("qid", "doc_idx", F.col("sim").alias("score")), covers).select("qid", "doc_idx", "rank")


@query(
    f"""WITH {_NEAR}, x AS (SELECT qid, vec_id AS doc_idx, rank, CASE WHEN rank % 3 = 0 THEN 0 ELSE 1 END AS tier, sim FROM n)
    SELECT qid, doc_idx, (row_number() OVER (PARTITION BY qid ORDER BY tier, CASE WHEN tier = 0 THEN rank ELSE 0 END, sim DESC, doc_idx))::INT AS rank FROM x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY tier, CASE WHEN tier = 0 THEN rank ELSE 0 END, sim DESC, doc_idx) <= 30"""
)
def retrieved_documents(spark, d):
    """The ranked ones in their order, filled up with the nearest of the others, cut at 30."""
    n = _near(spark, d).withColumnRenamed("vec_id", "doc_idx")
    ranked = n.where("rank % 3 = 0").select("qid", "doc_idx", F.col("sim").alias("score"), "rank")
    return retrieval.retrieved(ranked, n.select("qid", "doc_idx", "sim"), Config(retrieval_top_k=30)).select("qid", "doc_idx", "rank")


_PACK = "pk AS (SELECT qid, printf('P_%07d_%03d', vec_id % 9, vec_id) AS pid, vec_id % 9 AS doc, sim AS dense, (50 + vec_id % 13 * 60)::INT AS tokens, CASE WHEN vec_id % 4 < 3 THEN 'g' || vec_id % 4 END AS gid, (vec_id % 10) / 10.0::DOUBLE AS hit, rank FROM n)"


@query(
    f"""WITH RECURSIVE {_NEAR}, {_PACK}, s0 AS (SELECT * FROM pk WHERE rank = 3 AND tokens <= 900),
    c AS (SELECT DISTINCT pk.qid, 0 AS step, [x FOR x IN [CASE WHEN s0.pid IS NOT NULL THEN {{'pid': s0.pid, 'doc': s0.doc, 'gid': s0.gid, 'hit': s0.hit, 'tokens': s0.tokens}} END] IF x IS NOT NULL] AS chosen FROM pk LEFT JOIN s0 ON s0.qid = pk.qid
      UNION ALL (SELECT c.qid, c.step + 1, list_append(c.chosen, {{'pid': p.pid, 'doc': p.doc, 'gid': p.gid, 'hit': p.hit, 'tokens': p.tokens}}) FROM c JOIN pk p ON p.qid = c.qid AND NOT list_contains([x.pid FOR x IN c.chosen], p.pid)
        AND coalesce(list_sum([x.tokens FOR x IN c.chosen]), 0) + p.tokens <= 900 WHERE len(c.chosen) < 5
        QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY round(0.25 * p.dense + 0.75 * CASE WHEN p.gid IS NULL THEN 0 ELSE CASE WHEN p.gid = 'g0' THEN 2.0 ELSE 1.0 END
          * greatest(0.0, p.hit - coalesce(list_max([x.hit FOR x IN c.chosen IF x.gid = p.gid]), 0.0)) END - 0.1 * len([x FOR x IN c.chosen IF x.doc = p.doc]), 9) DESC, p.pid) = 1)),
    l AS (SELECT qid, arg_max(chosen, len(chosen)) AS chosen FROM c GROUP BY qid)
    SELECT qid, unnest(chosen).pid AS passage_id, (generate_subscripts(chosen, 1) - 1)::INT AS position, unnest(chosen).tokens AS token_count FROM l"""
)
def packed_evidence(spark, d):
    """A seed that fits, then the passage that covers the groups best, again and again, within 900 tokens."""
    n, v = _near(spark, d), F.col("vec_id")
    rows = n.select("qid", F.format_string("P_%07d_%03d", v % 9, v).alias("passage_id"), (v % 9).alias("doc_idx"), F.col("sim").alias("dense"), (50 + v % 13 * 60).cast("int").alias("tokens"), F.when(v % 4 < 3, F.concat(F.lit("g"), (v % 4).cast("string"))).alias("gid"), ((v % 10) / 10.0).alias("hit"), "rank")
    hits = rows.where("gid IS NOT NULL").select("qid", "gid", "passage_id", "hit")
    weights = rows.select("qid", F.lit("g0").alias("gid"), F.lit(2.0).alias("weight")).distinct()
    seeds = rows.where("rank = 3").select("qid", "passage_id", F.lit(1).alias("pos"))
    return retrieval.pack_evidence(rows.drop("gid", "hit", "rank"), hits, weights, seeds, Config(token_budget=900))


@query(
    f"""WITH RECURSIVE {_NEAR}, {_PACK}, o AS (SELECT qid, pid, tokens, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nr FROM pk),
    c AS (SELECT DISTINCT qid, 0::BIGINT AS nr, 0::BIGINT AS spent, 0 AS held, NULL::VARCHAR AS pid, 0 AS tokens FROM o
      UNION ALL SELECT c.qid, c.nr + 1, c.spent + CASE WHEN c.held < 5 AND c.spent + o.tokens <= 900 THEN o.tokens ELSE 0 END, c.held + CASE WHEN c.held < 5 AND c.spent + o.tokens <= 900 THEN 1 ELSE 0 END,
        CASE WHEN c.held < 5 AND c.spent + o.tokens <= 900 THEN o.pid END, o.tokens FROM c JOIN o ON o.qid = c.qid AND o.nr = c.nr + 1)
    SELECT qid, pid AS passage_id, (held - 1)::INT AS position, tokens AS token_count FROM c WHERE pid IS NOT NULL"""
)
def fallback_evidence(spark, d):
    """Without evidence the nearest passages are taken in order, past those that do not fit."""
    n, v = _near(spark, d), F.col("vec_id")
    rows = n.select("qid", F.format_string("P_%07d_%03d", v % 9, v).alias("passage_id"), "sim", (50 + v % 13 * 60).cast("int").alias("token_count"))
    none = rows.select("qid", "passage_id", F.lit(0).alias("position"), "token_count").limit(0)
    ranked = rows.select("qid", F.lit(0).cast("long").alias("doc_idx"), F.lit(1).alias("rank")).limit(0)
    return retrieval.with_fallback(none, ranked, ranked.withColumn("passage_id", F.lit("")), rows.select("qid", "passage_id", F.col("sim").alias("dense")), rows.select("passage_id", "token_count").distinct(), Config(token_budget=900))


@query(
    f"""WITH {_NEAR}, g AS (SELECT qid, label % 3 AS g, max(CASE WHEN rank <= 4 THEN 1 ELSE 0 END) AS met FROM n WHERE rank <= 12 GROUP BY ALL) SELECT qid, round(avg(met), 6) AS coverage FROM g GROUP BY qid"""
)
def group_coverage(spark, d):
    n = _near(spark, d).withColumn("passage_id", F.concat(F.lit("P"), F.col("vec_id").cast("string")))
    top = n.where("rank <= 12").select("qid", (F.col("label") % 3).alias("gid"), "passage_id")
    return retrieval.coverage(n.where("rank <= 4"), top).select("qid", F.round("coverage", 6).alias("coverage"))


@query(
    f"WITH {_NEAR} SELECT qid, 'P' || vec_id AS passage_id, CASE WHEN rank <= 10 THEN 'documents' WHEN rank % 2 = 0 THEN 'dense' ELSE 'walk' END AS origin FROM n WHERE rank <= 10 OR rank % 2 = 0 OR rank % 5 = 0"
)
def evidence_pools(spark, d):
    """A union of pools; a passage of several is credited to the first."""
    n = _near(spark, d).withColumn("passage_id", F.concat(F.lit("P"), F.col("vec_id").cast("string")))
    return retrieval.evidence_pool([("documents", n.where("rank <= 10")), ("dense", n.where("rank % 2 = 0")), ("walk", n.where("rank % 5 = 0"))])


@query(
    f"""WITH {_NEAR}, p AS (SELECT qid, vec_id % 6 AS doc_idx, printf('P_%07d_%03d', vec_id % 6, vec_id // 6) AS passage_id, round(sim, 1) AS sim FROM n)
    SELECT qid, doc_idx, passage_id, sim FROM p QUALIFY row_number() OVER (PARTITION BY qid, doc_idx ORDER BY sim DESC, passage_id) = 1"""
)
def best_passages(spark, d):
    """The best passage of each document; many are equal, then the first counts."""
    v = F.col("vec_id")
    rows = _near(spark, d).select("qid", (v % 6).alias("doc_idx"), F.format_string("P_%07d_%03d", v % 6, F.floor(v / 6)).alias("passage_id"), F.round("sim", 1).alias("sim"))
    return retrieval.best_per_doc(rows, ["qid"])


@query(
    f"""WITH {_NEAR}, q AS (SELECT n.qid, x.vec_id AS other FROM (SELECT DISTINCT qid FROM n) n, (VALUES (0), (1), (2)) o(k), v x WHERE x.vec_id = n.qid + o.k)
    SELECT n.qid, n.vec_id::VARCHAR AS passage_id, round(max(round(list_inner_product(p.e, a.e), 9)), 6) AS dense FROM n JOIN v p ON p.vec_id = n.vec_id JOIN q ON q.qid = n.qid JOIN v a ON a.vec_id = q.other GROUP BY ALL"""
)
def variant_scores(spark, d):
    """A passage's score is the greatest over a question's variants."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = _near(spark, d).select("qid", F.col("vec_id").cast("string").alias("passage_id"))
    asked = n.select("qid").distinct().withColumn("vec_id", F.explode(F.array(*[F.col("qid") + k for k in range(3)]))).join(v, "vec_id").select("qid", "embedding")
    return retrieval.dense_scores(n, v.select(F.col("vec_id").cast("string").alias("passage_id"), "embedding"), asked).select("qid", "passage_id", F.round("dense", 6).alias("dense"))


@query(
    f"""WITH {_TOP},
    gold AS (SELECT q.vec_id AS qid, list(x.vec_id) AS gold FROM v q JOIN v x ON x.label = q.label WHERE q.vec_id % 100 = 0 GROUP BY 1), l AS (SELECT query_id AS qid, list(vec_id ORDER BY rank) AS got FROM r WHERE rank <= 200 GROUP BY 1)
    SELECT {", ".join(f"round(avg(len(list_intersect(got[1:{k}], gold))::DOUBLE / len(gold)), 4) AS recall_{k}" for k in RECALL_AT)} FROM gold JOIN l USING (qid)"""
)
def mean_recall(spark, d):
    """Recall at all cut-offs, averaged."""
    docs = _vector_top(spark, d, 200).select(F.col("query_id").alias("qid"), F.col("vec_id").alias("doc_idx"), "rank")
    v = read(spark, d, "embeddings").select("vec_id", "label")
    gold = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label").join(v, "label").select("qid", F.col("vec_id").alias("doc_idx"))
    return Engine().evaluate(docs, gold)


# --- graphs

_NET = """raw AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'mentions' AS type, 0.08 AS cost FROM customer WHERE c_custkey % 4 > 0
  UNION ALL SELECT 'C' || c_custkey, 'C' || (c_custkey * 7 % 50), 'sim', 0.35 FROM customer WHERE c_custkey * 7 % 50 <> c_custkey
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'in_passage', 0.06 FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'mentions', 0.08 FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'S' || s_suppkey, 'S' || (s_suppkey * 3 + 1) % 10, 'entails', 0.2 FROM supplier WHERE (s_suppkey * 3 + 1) % 10 <> s_suppkey
  UNION ALL SELECT 'S' || s_suppkey, 'C' || s_suppkey, 'contradicts', 1.0 FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'in_doc', 0.05 FROM nation
  UNION ALL SELECT 'N' || n_nationkey, 'S' || n_nationkey % 10, 'in_doc', 0.05 FROM nation WHERE n_nationkey % 2 = 0),
seed AS (SELECT r_regionkey::BIGINT AS qid, 'S' || r_regionkey AS node, 2.0 AS w FROM region UNION ALL SELECT r_regionkey, 'N' || (r_regionkey + 5), 1.0 FROM region UNION ALL SELECT r_regionkey, 'X', 1.0 FROM region)"""


def _net(spark, d) -> tuple[DataFrame, DataFrame]:
    """Seeds, one of them outside, and directed edges with cycles, parallel and dangling ones."""
    n = lambda k, c: F.concat(F.lit(k), c.cast("string"))
    edge = lambda df, a, b, t, c: df.select(a.alias("src"), b.alias("dst"), F.lit(t).alias("type"), F.lit(c).alias("cost"))
    c, s, na = (read(spark, d, x) for x in ("customer", "supplier", "nation"))
    ck, sk, nk = F.col("c_custkey"), F.col("s_suppkey"), F.col("n_nationkey")
    parts = [
        edge(c.where("c_custkey % 4 > 0"), n("C", ck), n("N", F.col("c_nationkey")), "mentions", 0.08), edge(c.where("c_custkey * 7 % 50 <> c_custkey"), n("C", ck), n("C", ck * 7 % 50), "sim", 0.35),
        edge(s, n("S", sk), n("N", F.col("s_nationkey")), "in_passage", 0.06), edge(s.where("s_suppkey % 2 = 0"), n("S", sk), n("N", F.col("s_nationkey")), "mentions", 0.08),
        edge(s.where("(s_suppkey * 3 + 1) % 10 <> s_suppkey"), n("S", sk), n("S", (sk * 3 + 1) % 10), "entails", 0.2), edge(s, n("S", sk), n("C", sk), "contradicts", 1.0),
        edge(na, n("N", nk), n("R", F.col("n_regionkey")), "in_doc", 0.05), edge(na.where("n_nationkey % 2 = 0"), n("N", nk), n("S", nk % 10), "in_doc", 0.05),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    r = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("qid"))
    seeds = r.select("qid", n("S", F.col("qid")).alias("seed"), F.lit(2.0).alias("weight")).unionByName(r.select("qid", n("N", F.col("qid") + 5).alias("seed"), F.lit(1.0).alias("weight"))).unionByName(r.select("qid", F.lit("X").alias("seed"), F.lit(1.0).alias("weight")))
    return seeds, edges


_WEIGHT = "CASE type WHEN 'mentions' THEN 1.0 WHEN 'in_passage' THEN 1.0 WHEN 'in_doc' THEN 0.7 WHEN 'entails' THEN 0.5 ELSE 0.0 END / (1e-6 + cost)"
_CLOSE = f"""{_NET}, h0 AS (SELECT DISTINCT qid, node FROM seed), h1 AS (SELECT DISTINCT qid, dst AS node FROM h0 JOIN raw ON src = node), h2 AS (SELECT DISTINCT qid, dst AS node FROM h1 JOIN raw ON src = node),
allnd AS (SELECT qid, node, min(depth)::INT AS depth FROM (SELECT *, 0 AS depth FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL),
nd AS (SELECT * FROM allnd QUALIFY row_number() OVER (PARTITION BY qid ORDER BY depth, node) <= 9)"""


@query(f"WITH {_CLOSE} SELECT qid, node, depth FROM nd")
def capped_neighbourhood(spark, d):
    """Two hops from the seeds, cut at nine nodes: the nearest first."""
    seeds, edges = _net(spark, d)
    return graph.induce(seeds, edges, Config(max_nodes=9))


@query(f"WITH {_NET} SELECT src, dst, type, round({_WEIGHT}, 6) AS strength FROM raw")
def edge_strengths(spark, d):
    edges = _net(spark, d)[1]
    return edges.select("src", "dst", "type", F.round(graph.edge_strength(F.col("type"), F.col("cost")), 6).alias("strength"))


_WALK = """p{k} AS (SELECT s.qid, s.node, 0.15 * s.s + 0.85 * (coalesce(f.f, 0) + s.s * coalesce(l.l, 0)) AS score FROM sv s
  LEFT JOIN (SELECT m.qid, m.dst AS node, sum(p.score * m.p) AS f FROM p{j} p JOIN mv m ON m.qid = p.qid AND m.src = p.node GROUP BY ALL) f ON f.qid = s.qid AND f.node = s.node
  LEFT JOIN (SELECT p.qid, sum(p.score) AS l FROM p{j} p WHERE NOT EXISTS (SELECT 1 FROM mv m WHERE m.qid = p.qid AND m.src = p.node) GROUP BY p.qid) l ON l.qid = s.qid)"""
_PPR = f"""{_CLOSE}, st AS (SELECT src, dst, sum({_WEIGHT}) AS k FROM raw GROUP BY src, dst HAVING sum({_WEIGHT}) > 0),
mv AS (SELECT a.qid, src, dst, k / sum(k) OVER (PARTITION BY a.qid, src) AS p FROM allnd a JOIN st ON src = a.node JOIN allnd b ON b.qid = a.qid AND b.node = dst),
sw AS (SELECT a.qid, a.node, coalesce(sum(w), 0) AS w FROM allnd a LEFT JOIN seed ON seed.qid = a.qid AND seed.node = a.node GROUP BY ALL), sv AS (SELECT qid, node, w / sum(w) OVER (PARTITION BY qid) AS s FROM sw),
p0 AS (SELECT qid, node, s AS score FROM sv), {", ".join(_WALK.format(k=k, j=k - 1) for k in range(1, 11))}"""


def _walked(spark, d) -> DataFrame:
    seeds, edges = _net(spark, d)
    nodes = cut(graph.induce(seeds, edges))
    return graph.mini_ppr(seeds, nodes, edges.withColumn("strength", graph.edge_strength(F.col("type"), F.col("cost"))))


@query(f"WITH {_PPR} SELECT qid, node, round(score, 6) AS score FROM p10")
def walk_with_dead_ends(spark, d):
    """Ten steps on directed edges: mass of nodes without a way out goes back to the seeds, parallel edges add."""
    return _walked(spark, d).select("qid", "node", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_PPR}, x AS (SELECT qid, node, row_number() OVER (PARTITION BY qid, node[1] ORDER BY round(score, 7) DESC, node) AS rank FROM p10)
    SELECT qid, node, rank::INT AS rank, round(1.0::DOUBLE / (60 + rank), 9) AS rrf FROM x WHERE rank <= 5"""
)
def walk_ranks(spark, d):
    """Ranks of the first nodes of each kind."""
    walked = _walked(spark, d).select("qid", "node", F.round("score", 7).alias("score"), F.substring("node", 1, 1).alias("kind"))
    return graph.propagated_ranks(walked, Config(ppr_rrf_pool=5)).select("qid", "node", "rank", F.round("rrf", 9).alias("rrf"))


@query(
    f"""WITH {_CLOSE}, st AS (SELECT a.qid, src, dst, min(cost) AS c FROM allnd a JOIN raw ON src = a.node JOIN allnd b ON b.qid = a.qid AND b.node = dst GROUP BY ALL),
    w0 AS (SELECT qid, node AS source, node, 0.0::DOUBLE AS cost, [node] AS path FROM seed WHERE node LIKE 'S%'),
    w1 AS (SELECT w.qid, source, dst AS node, cost + c AS cost, list_append(path, dst) AS path FROM w0 w JOIN st ON st.qid = w.qid AND src = node),
    w2 AS (SELECT w.qid, source, dst AS node, cost + c AS cost, list_append(path, dst) AS path FROM w1 w JOIN st ON st.qid = w.qid AND src = node),
    w3 AS (SELECT w.qid, source, dst AS node, cost + c AS cost, list_append(path, dst) AS path FROM w2 w JOIN st ON st.qid = w.qid AND src = node),
    every AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)
    SELECT qid, source, node, round(min(cost), 6) AS cost FROM every GROUP BY ALL"""
)
def cheapest_ways(spark, d):
    """Cheapest ways of up to three edges on a graph with cycles and different costs."""
    seeds, edges = _net(spark, d)
    nodes = cut(graph.induce(seeds, edges))
    ways = graph.shortest_paths(seeds.where("seed LIKE 'S%'").select("qid", F.col("seed").alias("source")), edges, nodes, 3)
    return ways.select("qid", "source", "node", F.round("cost", 6).alias("cost"))


@query(
    f"WITH {_NET} SELECT src, dst FROM (SELECT src, dst, cost FROM raw WHERE type = 'sim' UNION ALL SELECT dst, src, cost FROM raw WHERE type = 'sim') QUALIFY row_number() OVER (PARTITION BY src ORDER BY cost, dst) <= 2"
)
def similar_neighbours(spark, d):
    return modelled.similar_neighbours(graph.both_ways(_net(spark, d)[1]), 2)


@query(
    f"""WITH {_NET}, b AS (SELECT src, dst, type, cost FROM raw UNION ALL SELECT dst, src, type, cost FROM raw)
    SELECT src AS node, string_agg(dst || ':' || type || ':' || cost, '|' ORDER BY dst, type, cost) AS neighbours FROM b GROUP BY src"""
)
def adjacency_lists(spark, d):
    made = readers.adjacency_lists(_net(spark, d)[1])
    shown = F.transform("neighbours", lambda x: F.concat_ws(":", x["to"], x["type"], x["cost"].cast("decimal(3,2)").cast("string")))
    return made.select("node", F.array_join(shown, "|").alias("neighbours"))


_ASK = """nd AS (SELECT conv_id AS qid, turn AS pos, 'q' || turn AS gid, CASE conv_id % 3 WHEN 0 THEN CASE WHEN turn = 3 THEN ['q1', 'q2', 'q3'] WHEN turn IN (1, 2) THEN ['q0'] WHEN turn >= 4 THEN ['q' || (turn - 2), 'zz'] ELSE []::VARCHAR[] END
    WHEN 1 THEN []::VARCHAR[] ELSE ['q' || (turn + 1) % 3] END AS dep FROM conversations),
dp AS (SELECT qid, gid AS child, unnest(dep) AS parent FROM nd), own AS (SELECT DISTINCT d.* FROM dp d JOIN nd ON nd.qid = d.qid AND nd.gid = d.parent WHERE child <> parent),
ed AS (SELECT qid, 'q0' AS src, gid AS dst FROM nd UNION ALL SELECT qid, 'q9', gid FROM nd),
par AS (SELECT qid, child, parent FROM own UNION SELECT e.qid, e.dst, e.src FROM ed e JOIN nd ON nd.qid = e.qid AND nd.gid = e.src WHERE e.src <> e.dst AND NOT EXISTS (SELECT 1 FROM own o WHERE o.qid = e.qid))"""


def _asked(spark, d) -> tuple[DataFrame, DataFrame]:
    """Question graphs with diamonds, references to nothing and to themselves, cycles, and ones that only edges connect."""
    t = F.col("turn")
    q = lambda x: F.concat(F.lit("q"), x.cast("string"))
    none = F.array().cast("array<string>")
    first = F.when(t == 3, F.array(F.lit("q1"), F.lit("q2"), F.lit("q3"))).when(t.isin(1, 2), F.array(F.lit("q0"))).when(t >= 4, F.array(q(t - 2), F.lit("zz"))).otherwise(none)
    dep = F.when(F.col("conv_id") % 3 == 0, first).when(F.col("conv_id") % 3 == 1, none).otherwise(F.array(q((t + 1) % 3)))
    nodes = read(spark, d, "conversations").select(F.col("conv_id").alias("qid"), t.cast("int").alias("pos"), q(t).alias("gid"), F.col("text").alias("question"), dep.alias("depends_on"))
    edges = nodes.select("qid", F.explode(F.array(F.lit("q0"), F.lit("q9"))).alias("src"), F.col("gid").alias("dst"))
    return nodes, edges


@query(f"WITH {_ASK} SELECT qid, child, parent FROM par")
def parents_of_any_form(spark, d):
    """Dependencies of nodes; edges count only where no node depends on another."""
    return dag.parents(*_asked(spark, d)).select("qid", "child", "parent")


@query(f"WITH {_ASK} SELECT qid, gid FROM nd WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.qid = nd.qid AND par.parent = nd.gid)")
def leaves_of_any_form(spark, d):
    nodes, edges = _asked(spark, d)
    return dag.leaves(nodes, dag.parents(nodes, edges)).select("qid", "gid")


@query(
    f"""WITH RECURSIVE {_ASK}, w AS (SELECT qid, gid, 0 AS n FROM nd UNION SELECT w.qid, par.child, w.n + 1 FROM w JOIN par ON par.qid = w.qid AND par.parent = w.gid WHERE w.n < 12),
    m AS (SELECT qid, gid, max(n) AS n FROM w GROUP BY ALL), cyc AS (SELECT DISTINCT qid FROM m WHERE n >= 12)
    SELECT nd.qid, nd.gid, CASE WHEN nd.qid IN (SELECT qid FROM cyc) THEN (row_number() OVER (PARTITION BY nd.qid ORDER BY nd.pos)) - 1 ELSE m.n END::INT AS level FROM nd JOIN m ON m.qid = nd.qid AND m.gid = nd.gid"""
)
def levels_of_any_form(spark, d):
    """Levels in graphs with diamonds; a graph with a cycle keeps its order."""
    nodes, edges = _asked(spark, d)
    return dag.topo_levels(nodes, dag.parents(nodes, edges)).select("qid", "gid", "level")


# --- sources and sinks


@query("SELECT page_id::BIGINT AS idx, url || chr(10) || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'text ' || page_id END AS doc FROM pages")
def corpus_from_json(spark, d):
    """A JSON array that is written and read as a corpus; some texts are missing."""
    rows = read(spark, d, "pages").select(F.col("url").alias("title"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("text "), F.col("page_id").cast("string"))).alias("text"), F.col("page_id").cast("long").alias("idx"))
    folder = _folder(spark, "corpus")
    lines = rows.select(F.to_json(F.struct("title", "text", "idx")).alias("value"))
    lines.select(F.concat(F.lit("["), "value", F.lit("]"))).write.text(folder)  # each line is an array of one object
    plain = spark.read.text(folder).select(F.explode(F.from_json("value", f"array<struct<{readers.CORPUS.replace(' ', ':')}>>".replace(",:", ","))).alias("r")).select("r.*")
    return readers.corpus_to_docs(plain).select("idx", "doc")


@query("SELECT item_id AS idx, length(text)::INT AS n FROM benchmark")
def json_lines(spark, d):
    folder = _folder(spark, "lines")
    readers.append_json(read(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("idx"), "text"), folder)
    readers.append_json(read(spark, d, "benchmark").where("item_id % 2 = 1").select(F.col("item_id").alias("idx"), "text"), folder)
    return readers.load_jsonl(spark, folder, "idx long, text string").select("idx", F.length("text").alias("n"))


@query("SELECT 'nation' AS name, count(*)::BIGINT AS n, true AS ready FROM nation UNION ALL SELECT 'edges', count(*), true FROM supplier")
def saved_index(spark, d):
    """Tables of an index that are written, found complete, and read back; the marker tells their rows."""
    folder = _folder(spark, "index")
    edges = read(spark, d, "supplier").select(F.col("s_name").alias("src"), F.col("s_nationkey").alias("dst"), F.lit("in_doc").alias("type"))
    before = readers.index_ready(spark, folder)
    readers.write_tables({"nation": read(spark, d, "nation"), "edges": edges}, folder, "{}", "{}")
    ready = readers.index_ready(spark, folder) and not before
    counts = {name: df.count() for name, df in readers.load_tables(spark, folder).items()}
    told = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    return readers.index_meta(spark, folder).where(F.col("rows") == told[F.col("name")]).select("name", F.col("rows").alias("n"), F.lit(ready).alias("ready"))


@query(
    """WITH t AS (SELECT *, conv_id % 3 AS f, role || chr(10) || coalesce(text, '') AS doc FROM conversations),
    g AS (SELECT conv_id, doc FROM t WHERE f = 0 AND turn % 2 = 1 UNION SELECT conv_id, role || chr(10) || coalesce(text, '') || '!' FROM t WHERE f = 1 AND role = 'user' UNION SELECT conv_id, doc FROM t WHERE f = 2 AND turn <> 1)
    SELECT conv_id, count(*)::BIGINT AS n, string_agg(doc, '|' ORDER BY doc) AS docs FROM g GROUP BY conv_id"""
)
def gold_of_three_shapes(spark, d):
    """Support as contexts, as facts that name titles, and as paragraphs that are not ruled out."""
    c = read(spark, d, "conversations").withColumn("f", F.col("conv_id") % 3)
    marked = F.struct(F.col("role").alias("title"), "text", (F.col("turn") % 2 == 1).alias("is_supporting"))
    contexts = c.where("f = 0").groupBy("conv_id").agg(F.collect_list(marked).alias("contexts"))
    held = F.struct(F.col("role").alias("title"), F.array(F.coalesce("text", F.lit("")), F.lit("!")).alias("sentences"))
    facts = c.where("f = 1").groupBy("conv_id").agg(F.collect_list(held).alias("context")).withColumn("supporting_facts", F.array(F.struct(F.lit("user").alias("title"), F.lit(0).alias("sent"))))
    ruled = F.struct(F.col("role").alias("title"), F.col("text").alias("paragraph_text"), F.when(F.col("turn") == 1, False).when(F.col("turn") == 2, True).alias("is_supporting"))
    paragraphs = c.where("f = 2").groupBy("conv_id").agg(F.collect_list(ruled).alias("paragraphs"))
    made = [readers.gold_docs(contexts), readers.gold_docs(facts, "hotpotqa"), readers.gold_docs(paragraphs)]
    whole = made[0].select("conv_id", "gold_docs").unionByName(made[1].select("conv_id", "gold_docs")).unionByName(made[2].select("conv_id", "gold_docs"))
    return whole.where(F.size("gold_docs") > 0).select("conv_id", F.size("gold_docs").cast("long").alias("n"), F.array_join(F.sort_array("gold_docs"), "|").alias("docs"))


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '|alias' WHEN n_nationkey % 3 = 1 THEN 'ref ' || n_name || '|alias' ELSE n_name || '|p1|p2|w' || n_nationkey || '|alias' END AS golds FROM nation"""
)
def gold_answers_of_three_shapes(spark, d):
    """Answers as such, as a reference, and as an object with possible answers and names; aliases are added to any."""
    r = read(spark, d, "nation").withColumn("answer_aliases", F.array(F.lit("alias"), F.lit("alias")))
    a = r.where("n_nationkey % 3 = 0").withColumn("answer", F.col("n_name"))
    b = r.where("n_nationkey % 3 = 1").withColumn("reference", F.concat(F.lit("ref "), "n_name"))
    o = r.where("n_nationkey % 3 = 2").withColumns({"obj": F.col("n_name"), "possible_answers": F.array(F.lit("p1"), F.lit("p2"), F.lit("p1")), "o_wiki_title": F.concat(F.lit("w"), F.col("n_nationkey").cast("string")), "o_aliases": F.lit(None).cast("array<string>")})
    whole = None
    for x in (a, b, o):
        part = readers.gold_answers(x).select("n_nationkey", F.array_join("gold_answers", "|").alias("golds"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query(f"WITH {_VEC} SELECT vec_id, round(sqrt(list_inner_product(e, e)), 5) AS before, CASE WHEN vec_id % 50 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS after FROM v")
def unit_vectors(spark, d):
    """Vectors brought to length one; those that are all zeros stay so."""
    e = F.col("embedding").cast("array<double>")
    v = read(spark, d, "embeddings").select("vec_id", e.alias("e"), F.when(F.col("vec_id") % 50 == 0, F.transform(e, lambda x: F.lit(0.0))).otherwise(F.transform(e, lambda x: x * 3)).alias("x"))
    size = lambda c: F.round(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), 5)
    return v.select("vec_id", size("e").alias("before"), size(l2_normalize("x")).alias("after"))
