"""Texts as sparse terms: representations, factors, naive Bayes, and the text classifier from cleaning to threshold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import digest
from ..functions.numeric import r6
from ..functions.text import normalise
from ..operators import decide as de, dedup, metrics as me, representations as rp, sparse_text as st, split as sp, svd, text_bayes as nb
from ..session import checkpointed
from .bindings import TEXTS_SQL, texts
from .catalog import query
from .flagship import _QS
from .splits import _SHARE, _counts, _quota, _ranked

#: Parameters of the registered queries.
WORDS, CHARS, SELECTED, RANK, ALPHA = 12_000, 12_000, 500, 64, 0.1

_SLOT = "cast('0x' || substr(sha256('61|' || cast(doc_id as varchar)), 1, 13) as ubigint) % 10"
_PARTS = f"{TEXTS_SQL}, docs as (select doc_id as id, text, label, case when {_SLOT} < 6 then 'train' when {_SLOT} < 8 then 'policy' else 'test' end as partition from texts)"


def _tfidf_sql(p, terms, limit, train):
    """Vocabulary of the training documents of ``docs`` and weights of all, from (id, term, c) rows named ``{p}dt``."""
    return f"""{p}dt as ({terms}), {p}tr as (select id from docs where {train}),
    {p}frq as (select term, sum(c) as f, count(*) as df from {p}dt join {p}tr using (id) group by 1 order by f desc, term limit {limit}),
    {p}voc as (select term, f, df, row_number() over (order by term) - 1 as position, ln((1 + (select count(*) from {p}tr)) / (1e0 + df)) + 1 as idf from {p}frq),
    {p}rw as (select id, term, position, c, (1 + ln(c)) * idf as w from {p}dt join {p}voc using (term)),
    {p}tw as (select id, term, position, c, w / sqrt(sum(w * w) over (partition by id)) as weight from {p}rw)"""


_WORD_TERMS = """with tok as (select id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as t from docs),
    pos as (select id, unnest(t) as w, generate_subscripts(t, 1) as i from tok),
    grm as (select id, w as term from pos union all select a.id, a.w || ' ' || b.w from pos a join pos b on a.id = b.id and b.i = a.i + 1)
    select id, term, count(*) as c from grm group by 1, 2"""
_CHAR_TERMS = """with wrd as (select id, ' ' || unnest(regexp_split_to_array(lower(text), '\\s+')) || ' ' as w from docs), cnt as (select id, w, count(*) as k from wrd where length(w) > 2 group by 1, 2),
    grm as (select id, k, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))) as term from cnt, (values (3), (4), (5)) s(n) where length(w) >= n)
    select id, term, cast(sum(k) as bigint) as c from grm group by 1, 2"""


def word_sql(train="partition = 'train'"):
    return _tfidf_sql("w", _WORD_TERMS, WORDS, train)


def bayes_sql(train="partition = 'train'"):
    """nbj (id, label, lj): joint log likelihood of every document; after :func:`word_sql`."""
    return f"""nbc as (select label, count(*) as n from docs where {train} group by 1),
    nbm as (select d.label, t.term, sum(weight) as m from wtw t join docs d using (id) where {train.replace('partition', 'd.partition')} group by 1, 2),
    nbg as (select c.label, v.term, coalesce(m, 0) as m from nbc c cross join wvoc v left join nbm on nbm.label = c.label and nbm.term = v.term),
    nbp as (select label, term, ln((m + {ALPHA}) / (sum(m) over (partition by label) + {ALPHA} * count(*) over (partition by label))) as lp from nbg),
    nbs as (select id, label, sum(weight * lp) as s from wtw join nbp using (term) group by 1, 2),
    nbj as (select d.id, c.label, ln(n / (select sum(n) from nbc)) + coalesce(s, 0) as lj from docs d cross join nbc c left join nbs on nbs.id = d.id and nbs.label = c.label)"""


def _split(spark, sf):
    """Labelled texts in training, policy and test parts by a draw of the document."""
    df = texts(spark, sf).select("doc_id", "text", "label")
    return sp.group_split(df, "doc_id", 61, [("train", 6), ("policy", 2), ("test", 2)])


def _representations(spark, sf):
    docs = checkpointed(_split(spark, sf))
    return docs, rp.TextRepresentations(docs.where("partition = 'train'"), "doc_id", "text", "label", WORDS, CHARS, SELECTED, RANK, 7)


_RANK = f"rnk as (select least({RANK}, least((select count(*) from wvoc), (select count(*) from wtr)) - 1) as k)"


@query(
    "fe4_truncated_svd",
    f"""with {_PARTS}, {word_sql()}, {_RANK}, e as (select id, round(sum(weight * weight), 6) as energy from wtw group by 1)
        select d.id as doc_id, partition, k as rank, coalesce(energy, 0) as energy, true as within_energy from docs d cross join rnk left join e using (id)""",
)
def fe4(spark, sf):
    """Projected documents. SQL knows a row's energy, which its projection cannot pass, and the rank."""
    docs, fitted = _representations(spark, sf)
    rows = fitted._words(docs, ["doc_id", "partition"])
    out = svd.project(rows, fitted.factors.components)
    energy = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    kept = F.aggregate("svd", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("doc_id", "partition", F.size("svd").cast("bigint").alias("rank"), r6(energy).alias("energy"), (kept <= energy + 1e-9).alias("within_energy"))


@query(
    "fe4_svd_certificate",
    f"""with {_PARTS}, {word_sql()}, {_RANK}, g as (select count(distinct id) as total from wtw join wtr using (id))
        select i.range as i, j.range as j, case when i.range = j.range then 1e0 else 0e0 end as dot, true as eigenvector, cast(total as double) as energy, true as in_order
        from rnk, range(0, 1000) i, range(0, 1000) j, g where i.range <= j.range and j.range < k""",
)
def fe4c(spark, sf):
    """One row for each pair of components: their inner product, and whether each is an eigenvector of the Gram matrix within a hundredth of its largest eigenvalue."""
    _, fitted = _representations(spark, sf)
    f, train = fitted.factors, fitted._train_words
    dots, left = f.components.T @ f.components, svd.residuals(train, f)
    energy = train.agg(F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x))).scalar()
    rows = [
        (i, j, abs(round(float(dots[i, j]), 6)), bool(max(left[i], left[j]) < 1e-2), bool(f.values[i] >= f.values[j]))
        for i in range(len(f.values)) for j in range(i, len(f.values))
    ]
    return spark.createDataFrame(rows, "i bigint, j bigint, dot double, eigenvector boolean, in_order boolean").withColumn("energy", r6(energy))


@query(
    "fe6_feature_union",
    f"""with {_PARTS}, {word_sql()}, {_tfidf_sql('c', _CHAR_TERMS, CHARS, "partition = 'train'")},
        u as (select id, weight, position, 1 as word from wtw union all select id, weight, position + (select count(*) from wvoc), 0 from ctw)
        select d.id as doc_id, count(u.id) filter (word = 1) as word_entries, count(u.id) filter (word = 0) as char_entries, coalesce(round(sum(weight * weight), 6), 0) as energy,
          coalesce(round(sum(weight * (position + 1)), 3), 0) as moment from docs d left join u using (id) group by 1""",
)
def fe6(spark, sf):
    """Word and character weights side by side in one sparse vector."""
    docs, fitted = _representations(spark, sf)
    rows = fitted.transform(docs, "linear", ["doc_id"])
    words = len(fitted.word_block[1])
    return rows.select(
        "doc_id", F.size(F.filter("indices", lambda i: i < words)).cast("bigint").alias("word_entries"), F.size(F.filter("indices", lambda i: i >= words)).cast("bigint").alias("char_entries"),
        r6(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)).alias("energy"),
        F.round(F.aggregate(F.zip_with("indices", "values", lambda i, x: (i + 1) * x), F.lit(0.0), lambda a, x: a + x), 3).alias("moment"),
    )


@query("fe11_text_representation", f"with {_PARTS}, {word_sql()}, {_RANK} select i.range as component, (select count(*) from wtr) as rows, 0e0 as mean, 1e0 as sd from rnk, range(0, 1000) i where i.range < k")
def fe11(spark, sf):
    """Terms, factors and scaling fitted on training rows; their scaled coordinates have mean 0 and deviation 1."""
    docs, fitted = _representations(spark, sf)
    rows = fitted.transform(docs.where("partition = 'train'"), "dense", ["doc_id"])
    each = rows.select(F.posexplode("vector").alias("component", "x")).groupBy(F.col("component").cast("bigint").alias("component"))
    return each.agg(F.count(F.lit(1)).alias("rows"), F.abs(F.round(F.avg("x"), 6)).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"))


_CHI = f"""cls as (select label, count(*) / sum(count(*)) over () as share from docs where partition = 'train' group by 1),
  obs as (select term, label, sum(weight) as o from wtw join docs using (id) where partition = 'train' group by 1, 2), tot as (select term, sum(o) as t from obs group by 1),
  chi as (select tot.term, round(sum(pow(coalesce(o, 0) - t * share, 2) / (t * share)), 9) as chi2 from tot cross join cls left join obs on obs.term = tot.term and obs.label = cls.label group by 1),
  sel as (select term from chi order by chi2 desc, term limit {SELECTED})"""
_FAMILIES = ", ".join(f"('{f}', '{r}')" for f, r in rp.FAMILIES.items())


@query(
    "fe14_representation_routing",
    f"""with {_PARTS}, {word_sql()}, {_tfidf_sql('c', _CHAR_TERMS, CHARS, "partition = 'train'")}, {_RANK}, {_CHI}, tr as (select wtw.* from wtw join wtr using (id)),
        r as (select 'linear' as representation, (select count(*) from wvoc) + (select count(*) from cvoc) as width, (select sum(weight * weight) from tr) + (select sum(weight * weight) from ctw join ctr using (id)) as energy
          union all select 'word', (select count(*) from wvoc), (select sum(c * c) from tr)
          union all select 'tree', (select count(*) from sel), (select sum(weight * weight) from tr join sel using (term))
          union all select 'dense', k, k * (select count(*) from wtr) from rnk union all select 'knn', k, (select count(distinct id) from tr) from rnk)
        select family, representation, width, (select count(*) from wtr) as rows, round(energy, 4) as energy from (values {_FAMILIES}) f(family, representation) join r using (representation)""",
)
def fe14(spark, sf):
    """Every family with what it reads of the training rows: width and sum of squares."""
    docs, fitted = _representations(spark, sf)
    train = docs.where("partition = 'train'")
    parts = {}
    for name in dict.fromkeys(rp.FAMILIES.values()):
        rows = fitted.transform(train, name, ["doc_id"])
        column = "vector" if "vector" in rows.columns else "values"
        parts[name] = rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.aggregate(column, F.lit(0.0), lambda a, x: a + x * x)), 4).alias("energy"))
    out = None
    for family, name in rp.FAMILIES.items():
        one = parts[name].select(F.lit(family).alias("family"), F.lit(name).alias("representation"), F.lit(fitted.width(name)).cast("bigint").alias("width"), "rows", "energy")
        out = one if out is None else out.unionAll(one)
    return out


def _bayes(rows, train, width):
    model, prior = nb.fit(train, "label", width, ALPHA)
    return nb.joint(rows, "doc_id", checkpointed(model), prior)


@query(
    "ml8_multinomial_naive_bayes",
    f"""with {_PARTS}, {word_sql()}, {bayes_sql()}, top as (select id, max(lj) as best, arg_max(label, lj) as prediction from nbj group by 1)
        select top.id as doc_id, prediction, round(best, 4) as log_joint, round(1 / sum(exp(lj - best)), 6) as probability from top join nbj using (id) join docs d on d.id = top.id where partition = 'test' group by 1, 2, best""",
)
def ml8m(spark, sf):
    """Text naive Bayes on TF-IDF weights: vocabulary and model of the training rows, scores of the test rows."""
    docs, fitted = _representations(spark, sf)
    test = fitted._words(docs.where("partition = 'test'"), ["doc_id"])
    out = nb.predict(_bayes(test, fitted._train_words, len(fitted.word_block[1])), "doc_id")
    return out.select("doc_id", "prediction", F.round("log_joint", 4).alias("log_joint"), r6(F.col("probability")).alias("probability"))


@query("ml8_multinomial_model", f"with {_PARTS}, {word_sql()}, {bayes_sql()} select label, term, round(lp, 6) as log_prob from nbp")
def ml8t(spark, sf):
    _, fitted = _representations(spark, sf)
    vocabulary = fitted.word_block[1]
    model, _ = nb.fit(fitted._train_words, "label", len(vocabulary), ALPHA)
    names = vocabulary.frame(spark).select("term", F.col("position").alias("index"))
    return model.join(names, "index").select("label", "term", r6(F.col("log_prob")).alias("log_prob"))


_FLAGSHIP = f"""with {TEXTS_SQL}, nrm as (select doc_id, replace(text, '<br />', ' ') as text, label, official from texts),
  keyed as (select *, sha256(text) as case_id from nrm), ok as (select case_id from keyed group by 1 having count(distinct label) = 1),
  snap as (select * from (select *, row_number() over (partition by case_id order by official, doc_id) as r from keyed where case_id in (select case_id from ok)) where r = 1),
  pool0 as (select 'all' as dataset, case_id, label from snap),
  {_counts('c0', 'pool0')}, {_quota('h', 'c0', _SHARE.format('2e-1'), 1)}, {_ranked('pool0', 51, name='hold')},
  test as (select case_id, label from hold join h_q using (dataset, label) where rn <= quota),
  pool as (select * from pool0 where case_id not in (select case_id from test)),
  {_counts('d0', 'pool')}, {_quota('a', 'd0', _SHARE.format('2e-1'), 0)}, {_ranked('pool', 52)}, pol as (select case_id, label from ranked join a_q using (dataset, label) where rn <= quota),
  docs as (select case_id as id, text, label, case when case_id in (select case_id from test) then 'test' when case_id in (select case_id from pol) then 'policy' else 'train' end as partition from snap),
  {word_sql()}, {bayes_sql()},
  sco as (select id, round(1 / (1 + exp(max(lj) filter (label = 0) - max(lj) filter (label = 1))), 6) as score from nbj group by 1),
  lab as (select d.id, d.label, d.partition, score from docs d join sco using (id)), polv as (select * from lab where partition = 'policy'),
  cand as (select distinct t from (select unnest(quantile_cont(score, {_QS})) as t from polv union all select 5e-1 union all select max(score) * (1 + 2.220446049250313e-16) from polv)),
  val as (select t, (count(*) filter (label = 1 and score >= t) / count(*) filter (label = 1) + count(*) filter (label = 0 and score < t) / count(*) filter (label = 0)) / 2 as ba from cand, polv group by 1),
  thr as (select t from val order by ba desc, abs(t - 5e-1), t limit 1),
  pan as (select 'raw' as panel, label, cast(score >= 5e-1 as integer) as p from lab where partition = 'test' union all select 'adjusted', label, cast(score >= t as integer) from lab, thr where partition = 'test')
  select panel, count(*) as n, round((avg(p) filter (label = 1) + 1 - avg(p) filter (label = 0)) / 2, 6) as balanced_accuracy from pan group by 1"""


@query("flagship_text_classifier", _FLAGSHIP)
def flagship_classifier(spark, sf):
    """Labelled texts: clean, hold out, fit vocabulary and naive Bayes, choose the threshold on policy rows, evaluate on the holdout."""
    raw = texts(spark, sf).select("doc_id", normalise(F.col("text")).alias("text"), "label", "official")
    snapshot = dedup.clean_snapshot(raw.withColumn("case_id", digest("text")), "case_id", "label", ["official", "doc_id"])
    cases = checkpointed(snapshot.select("case_id", "label", "text"))
    pool, test = sp.shared_holdout(cases.drop("text"), "case_id", "label", 51)
    parts = sp.stratified_split(pool, "case_id", "label", 52, [("policy", 0.2), ("validation", 0.25)])
    split = parts.select("case_id", F.when(F.col("partition") == "policy", "policy").otherwise("train").alias("partition")).unionByName(test.select("case_id", F.lit("test").alias("partition")))
    docs = checkpointed(cases.join(split, "case_id"))
    block = st.word_terms(F.col("text")), st.fit_vocabulary(docs.where("partition = 'train'"), st.word_terms(F.col("text")), WORDS)
    rows = checkpointed(st.encode(docs, [block], ["case_id", "label", "partition"]))
    model, prior = nb.fit(rows.where("partition = 'train'"), "label", len(block[1]), ALPHA)
    scored = nb.joint(rows.where("partition <> 'train'").select("case_id", "indices", "values"), "case_id", checkpointed(model), prior)
    by = lambda c: F.max(F.when(F.col("label") == c, F.col("log_joint")))
    score = scored.groupBy("case_id").agg(r6(1 / (1 + F.exp(by(0) - by(1)))).alias("score"))
    found = checkpointed(rows.select("case_id", "label", "partition").join(score, "case_id").withColumn("task", F.lit("quality")))
    thresholds = de.choose_threshold(found.where("partition = 'policy'"), ["task"], "label", "score", 0.5)
    final = found.where("partition = 'test'").withColumn("raw", (F.col("score") >= 0.5).cast("int"))
    long = de.panels(de.apply_threshold(final, ["task"], "score", "raw", thresholds))
    conf = me.confusion(long, ["panel"])
    both = me.accuracy(conf, ["panel"]).select("panel", "n").join(me.balanced_accuracy_present(me.class_table(conf, ["panel"], 2), ["panel"]), "panel")
    return both.withColumn("balanced_accuracy", r6(F.col("balanced_accuracy")))
