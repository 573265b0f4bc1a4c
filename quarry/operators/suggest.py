"""Auto-completion over dictionaries, n-gram and character models.

Prefix completion keeps the best entries of every prefix (:func:`completions`), so
a lookup is an equi-join on the prefix. Where all matches are needed, or a prefix
is longer than those kept, matching is an equi-join on a short key plus an exact
``startswith`` filter: every dictionary entry is indexed under its prefixes of
length 1..``key_len`` and a lookup joins on ``substr(prefix, 1, key_len)``. Lookups
are the (size-checked, broadcast) query side; best-k per lookup uses the
window top-k (partial limit before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import standard_tokens
from quarry.operators.search import top_k
from quarry.session import checked_broadcast, cut_lineage

KEY_LEN = 4
#: Longest prefix whose best completions are kept.
LONGEST = 48


def prefix_index(dictionary: DataFrame, entry_col: str = "entry", key_len: int = KEY_LEN) -> DataFrame:
    """``(key, <dictionary columns>)``: each entry under its prefixes of length 1..key_len."""
    e = F.col(entry_col)
    keys = F.transform(F.sequence(F.lit(1), F.least(F.length(e), F.lit(key_len))), lambda i: F.substring(e, 1, i))
    return (dictionary.filter(F.length(e) > 0)
            .select("*", F.explode_outer(keys).alias("key")).filter(F.col("key").isNotNull()))


def lookup_key(prefix: Column, key_len: int = KEY_LEN) -> Column:
    return F.substring(prefix, 1, key_len)


def prefix_matches(dictionary: DataFrame, lookups: DataFrame, entry_col: str = "entry",
                   key_len: int = KEY_LEN) -> DataFrame:
    """Every dictionary row whose ``entry`` starts with the lookup's ``prefix``.
    ``lookups(lookup_id, prefix)``; empty prefixes match nothing."""
    idx = prefix_index(dictionary, entry_col, key_len)
    lk = checked_broadcast(lookups.filter(F.length("prefix") > 0).withColumn("key", lookup_key(F.col("prefix"), key_len)))
    return idx.join(lk, "key").filter(F.col(entry_col).startswith(F.col("prefix"))).drop("key")


def completions(dictionary: DataFrame, k: int = 3, by: str = "weight", entry_col: str = "entry",
                longest: int = LONGEST) -> DataFrame:
    """``(prefix, <dictionary columns>, rank)``: the ``k`` best entries under every prefix of up to ``longest`` characters.

    Best is by weight, or alphabetical (``by='alpha'``); ties by entry. Partitions keep their best ``k`` of a prefix before
    anything is shuffled, so a short prefix that half the dictionary shares costs ``k`` rows a partition. Write the
    table once and a lookup is one row's worth of work, however large the dictionary.
    """
    each = prefix_index(dictionary, entry_col, longest).withColumnRenamed("key", "prefix")
    score = F.lit(0.0) if by == "alpha" else F.col("weight").cast("double")
    return top_k(each.withColumn("_b", score), k, score_col="_b", group_col="prefix", id_col="entry").drop("_b")


def complete(table: DataFrame, dictionary: DataFrame, lookups: DataFrame, k: int = 3, by: str = "weight",
             entry_col: str = "entry", longest: int = LONGEST) -> DataFrame:
    """``(lookup_id, <dictionary columns>, rank)`` from a table of :func:`completions`, by an equi-join on the prefix.

    Lookups longer than its prefixes are matched with the dictionary itself. Empty ones match nothing.
    """
    asked = lookups.select("lookup_id", "prefix").filter(F.length("prefix") > 0)
    out = table.join(checked_broadcast(asked.filter(F.length("prefix") <= longest)), "prefix").drop("prefix")
    rest = prefix_matches(dictionary, asked.filter(F.length("prefix") > longest), entry_col)
    score = F.lit(0.0) if by == "alpha" else F.col("weight").cast("double")
    rest = top_k(rest.withColumn("_b", score), k, score_col="_b", group_col="lookup_id", id_col="entry")
    return out.unionByName(rest.select(*out.columns))


def suggest_prefix(dictionary: DataFrame, lookups: DataFrame, k: int = 3, by: str = "alpha") -> DataFrame:
    """G1 (``by='alpha'``: trie order) / weight order: ``(lookup_id, entry, weight, rank)``."""
    return complete(completions(dictionary, k, by), dictionary, lookups, k, by)


def analyzed(text: Column) -> Column:
    """Analysed key of a suggestion or lookup: standard tokens joined by one
    blank, with a trailing blank kept when the text ends in whitespace."""
    toks = standard_tokens(text)
    base = F.array_join(toks, " ")
    return F.when((F.size(toks) > 0) & text.rlike(r"\s$"), F.concat(base, F.lit(" "))).otherwise(base)


def suggest_analyzing(dictionary: DataFrame, lookups: DataFrame, k: int = 3) -> DataFrame:
    """Prefix match on the analysed forms, ordered by weight desc."""
    d = dictionary.withColumn("akey", analyzed(F.col("entry")))
    l = lookups.select("lookup_id", analyzed(F.col("prefix")).alias("prefix"))
    return complete(completions(d, k, entry_col="akey"), d, l, k, entry_col="akey").drop("akey")


def suggest_infix(dictionary: DataFrame, lookups: DataFrame, k: int = 3, key_len: int = KEY_LEN) -> DataFrame:
    """Every complete lookup token must be a token of the entry and the
    last (partial) token must prefix one of its tokens; weight desc."""
    d = dictionary.withColumn("etoks", standard_tokens(F.col("entry")))
    lt = standard_tokens(F.col("prefix"))
    ends_blank = F.col("prefix").rlike(r"\s$")
    l = lookups.select("lookup_id", lt.alias("lt"), ends_blank.alias("eb")).filter(F.size("lt") > 0).select(
        "lookup_id",
        F.when(F.col("eb"), F.col("lt")).otherwise(F.slice("lt", 1, F.size("lt") - 1)).alias("full"),
        F.when(F.col("eb"), F.lit(None).cast("string")).otherwise(F.element_at("lt", -1)).alias("partial"))
    # anchor = the partial token, else the first full token; candidates share its key
    l = l.withColumn("anchor", F.coalesce("partial", F.element_at("full", 1)))
    tok_idx = d.select("entry", "weight", "etoks", F.explode_outer(F.array_distinct("etoks")).alias("tok")).filter(
        F.col("tok").isNotNull())
    tok_idx = tok_idx.select("*", F.explode_outer(F.transform(
        F.sequence(F.lit(1), F.least(F.length("tok"), F.lit(key_len))), lambda i: F.substring(F.col("tok"), 1, i))).alias("key"))
    lk = checked_broadcast(l.withColumn("key", F.substring("anchor", 1, key_len)))
    m = tok_idx.join(lk, "key").filter(F.col("tok").startswith(F.col("anchor")))
    ok = (F.forall("full", lambda t: F.array_contains(F.col("etoks"), t))
          & (F.col("partial").isNull() | F.exists("etoks", lambda x: x.startswith(F.col("partial")))))
    m = m.filter(ok).select("lookup_id", "entry", "weight").dropDuplicates(["lookup_id", "entry"])
    return top_k(m.withColumn("_s", F.col("weight").cast("double")), k, score_col="_s",
                 group_col="lookup_id", id_col="entry").drop("_s")


def ngram_counts(tokens: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Unigram ``(w, c)`` and bigram ``(w1, w2, c)`` counts from ``(doc_id, pos, term)``.
    The bigram is an equi-join on (doc_id, pos + 1) — unique keys, no window."""
    uni = tokens.groupBy(F.col("term").alias("w")).agg(F.count(F.lit(1)).alias("c"))
    a = tokens.select(id_col, F.col("pos").alias("p"), F.col("term").alias("w1"))
    b = tokens.select(id_col, (F.col("pos") - 1).alias("p"), F.col("term").alias("w2"))
    bi = a.join(b, [id_col, "p"]).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"))
    return uni, bi


def bigram_counts(texts: DataFrame, text_col: str = "text", analyzer="standard") -> DataFrame:
    """Bigram counts ``(w1, w2, c)`` of adjacent tokens, built inside each row.

    The token array is zipped with itself shifted by one, so the pairs come
    out of the scan with no join and no shuffle of the token stream; the
    count is a partial (map-side) aggregate keyed by the word pair. Same
    result as :func:`ngram_counts` when positions have no holes.
    """
    from quarry.functions.text import analyzer as get_analyzer

    fn = get_analyzer(analyzer) if isinstance(analyzer, str) else analyzer
    t = texts.select(fn(F.col(text_col)).alias("_t"))
    n = F.size("_t") - 1
    pairs = F.when(n > 0, F.arrays_zip(F.slice("_t", 1, n).alias("w1"), F.slice("_t", 2, n).alias("w2")))
    return (t.select(F.explode(pairs).alias("p")).select("p.w1", "p.w2")
            .groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")))


def suggest_ngram(uni: DataFrame, bi: DataFrame, lookups: DataFrame, k: int = 3, backoff: float = 0.4) -> DataFrame:
    """Complete the last (partial) word — or predict the next one after a
    trailing blank — from bigram counts P(w | previous word) = c(prev, w) /
    c(prev); when fewer than ``k`` bigram completions exist, fill with unigram
    completions not already found, scored ``backoff · c(w) / N`` (without a
    previous word unigrams score ``c(w) / N``)."""
    lt = standard_tokens(F.col("prefix"))
    eb = F.col("prefix").rlike(r"\s$")
    l = lookups.select("lookup_id", lt.alias("lt"), eb.alias("eb")).filter(F.size("lt") > 0).select(
        "lookup_id",
        F.when(F.col("eb"), F.element_at("lt", -1)).otherwise(
            F.when(F.size("lt") > 1, F.element_at("lt", -2))).alias("prev"),
        F.when(F.col("eb"), F.lit("")).otherwise(F.element_at("lt", -1)).alias("partial"))
    l = checked_broadcast(l)
    n_total = float(uni.agg(F.sum("c")).first()[0] or 1)
    ctx = uni.select(F.col("w").alias("prev"), F.col("c").alias("cprev"))
    bcand = (bi.withColumnRenamed("w1", "prev").join(l.filter(F.col("prev").isNotNull()), "prev")
             .filter(F.col("w2").startswith(F.col("partial"))).join(ctx, "prev")
             .select("lookup_id", F.col("w2").alias("word"), (F.col("c") / F.col("cprev")).alias("score")))
    btop = top_k(bcand, k, group_col="lookup_id", id_col="word").drop("rank")
    # unigram completions: the best 2k per lookup still hold k after removing
    # the (at most k) words the bigram model already found
    idx = prefix_index(uni.select(F.col("w").alias("word"), "c"), "word")
    lk_p = l.filter(F.length("partial") > 0).withColumn("key", lookup_key(F.col("partial")))
    u_pref = (idx.join(checked_broadcast(lk_p), "key").filter(F.col("word").startswith(F.col("partial")))
              .select("lookup_id", "prev", "word", "c"))
    best = uni.orderBy(F.col("c").desc(), F.col("w").asc()).limit(2 * k).collect()  # 2k rows, global
    lit_best = F.array(*[F.struct(F.lit(r["w"]).alias("word"), F.lit(r["c"]).alias("c")) for r in best])
    u_next = (l.filter(F.length("partial") == 0).select("lookup_id", "prev", F.explode(lit_best).alias("u"))
              .select("lookup_id", "prev", "u.word", "u.c"))
    ucand = u_pref.unionByName(u_next).withColumn(
        "score", F.col("c") / F.lit(n_total) * F.when(F.col("prev").isNotNull(), F.lit(backoff)).otherwise(F.lit(1.0)))
    utop = top_k(ucand.select("lookup_id", "word", "score"), 2 * k, group_col="lookup_id", id_col="word")
    utop = utop.join(btop.select("lookup_id", "word"), ["lookup_id", "word"], "left_anti")
    nb = btop.groupBy("lookup_id").agg(F.count(F.lit(1)).alias("nb"))
    ufill = top_k(utop.drop("rank"), k, group_col="lookup_id", id_col="word").join(nb, "lookup_id", "left").filter(
        F.col("rank") <= F.lit(k) - F.coalesce("nb", F.lit(0))).select("lookup_id", "word", "score")
    out = btop.select("lookup_id", "word", "score").unionByName(ufill)
    return top_k(out, k, group_col="lookup_id", id_col="word")


def char_grams(text: Column, width: int) -> Column:
    """All overlapping windows of ``width`` characters of a string, in order.

    One regex pass with a capturing lookahead (``(?=(.{w}))``) — linear in the
    text and code-generated, unlike per-offset ``substring`` (which rescans the
    UTF-8 string from the start) or a lambda over a character array (which
    runs interpreted). Texts shorter than ``width`` give an empty array.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{int(width)}}}))"), 1)


def char_lm_counts(texts: DataFrame, n: int = 3, text_col: str = "text") -> DataFrame:
    """Order-n character model counts ``(context, next, count)``."""
    g = texts.select(F.explode(char_grams(F.col(text_col), n + 1)).alias("g"))
    return g.groupBy(F.substring("g", 1, n).alias("context"), F.substring("g", n + 1, 1).alias("next")).agg(
        F.count(F.lit(1)).alias("count"))


def char_lm_table(counts: DataFrame) -> DataFrame:
    """Cumulative distribution per context: ``(context, next, lo, hi, logp)``.
    Windows are per context (bounded by the alphabet size)."""
    from pyspark.sql import Window
    w = Window.partitionBy("context").orderBy("next")
    tot = Window.partitionBy("context")
    c = counts.withColumn("t", F.sum("count").over(tot)).withColumn("hi", F.sum("count").over(w))
    return c.select("context", "next", ((F.col("hi") - F.col("count")) / F.col("t")).alias("lo"),
                    (F.col("hi") / F.col("t")).alias("hi"), F.log(F.col("count") / F.col("t")).alias("logp"))


def sample_continuations(prompts: DataFrame, table: DataFrame, n: int = 3, num: int = 3, max_len: int = 40,
                         end: str = "\n", seed: int = 11, checkpoint_every: int = 5) -> DataFrame:
    """``num`` sampled continuations per prompt, character by character,
    at most ``max_len`` characters, stopping at the end symbol or at an unseen
    context. Each step is one equi-join on the last ``n`` characters plus a
    range filter on a hash-seeded draw (deterministic under retries); lineage
    is cut every ``checkpoint_every`` steps. Weight = total log-probability.
    Output ``(prompt_id, sample, text, logp)``."""
    # the model is small (bounded by the checked broadcast) and read at every
    # step: materialise it once instead of re-deriving it from the corpus
    tab = checked_broadcast(cut_lineage(table.select("context", "next", "lo", "hi", F.col("logp").alias("lp"))))
    live = prompts.select("prompt_id", "prompt", F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("sample")).select(
        "prompt_id", "sample", "prompt", F.lit("").alias("gen"), F.lit(0.0).alias("logp"), F.lit(False).alias("done"))
    finished = []
    for step in range(max_len):
        # finished samples get a null key: the left join passes them through unchanged
        ctx = F.when(~F.col("done"), F.substring(F.concat("prompt", "gen"), -n, n))
        u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "prompt_id", "sample", F.lit(step))), 1, 8), 16, 10)
             .cast("double") / F.lit(4294967296.0))
        cur = live.withColumn("context", ctx).withColumn("u", u)
        nxt = cur.join(tab, "context", "left").filter(
            F.col("next").isNull() | ((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))))
        live = nxt.select("prompt_id", "sample", "prompt",
                          F.when(F.col("next").isNull() | (F.col("next") == F.lit(end)), F.col("gen"))
                          .otherwise(F.concat("gen", "next")).alias("gen"),
                          (F.col("logp") + F.coalesce("lp", F.lit(0.0))).alias("logp"),
                          (F.col("done") | F.col("next").isNull() | (F.col("next") == F.lit(end))
                           | (F.length("gen") + 1 >= max_len)).alias("done"))
        if (step + 1) % checkpoint_every == 0 or step == max_len - 1:
            live = cut_lineage(live)
            finished.append(live.filter(F.col("done")))
            live = live.filter(~F.col("done"))
    st = finished[0]
    for f in finished[1:]:
        st = st.unionByName(f)
    return st.select("prompt_id", "sample", F.col("gen").alias("text"), "logp")
