"""Training-example tables (T1–T8) over ``conversations``.

Parallel pairs are (user turn, the assistant turn right after it, same
conversation) — an equi-join on ``(conv_id, turn + 1)``. Lines for the
next-line model are all turns of a conversation in turn order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import corpus as C
from quarry.plans import register
from quarry.plans.common import tbl

ROW_SIZE = 40
PARALLEL_MAX = 2_000_000
LINES_MAX = 20_000
BATCH = 32
MACRO = 20

# Characters reserved in the line vocabulary right after
# <unk> <eos> <go>, in this order: "-\/_&" followed by the 27 specials.
RESERVED_CHARS = "-\\/_&" + T.SPECIALS
LINE_RESERVED = tuple(dict.fromkeys([C.UNK, C.EOS, C.GO, *RESERVED_CHARS]))


def _pairs(spark, sf_dir):
    c = tbl(spark, sf_dir, "conversations")
    a = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source"))
    b = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("target"))
    return a.join(b, ["conv_id", "turn"])


def _lines(spark, sf_dir):
    return tbl(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def _counts(words_df):
    return words_df.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _parallel_vocab(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    w = (p.select(F.explode(T.whitespace_tokens(F.col("source"))).alias("word"))
         .unionByName(p.select(F.explode(T.whitespace_tokens(F.col("target"))).alias("word"))))
    return C.build_vocab(_counts(w), PARALLEL_MAX)


def _line_vocab(spark, sf_dir):
    w = _lines(spark, sf_dir).select(F.explode(T.special_tokens(F.col("text"))).alias("word"))
    return C.build_vocab(_counts(w), LINES_MAX, reserved=LINE_RESERVED)


def _vocab_out(v):
    return v.select("word", F.col("id").cast("int"), F.col("freq").cast("long"))


# ---- SQL pieces --------------------------------------------------------------
def _sql_ws(c):
    return f"list_filter(string_split_regex(coalesce({c}, ''), '\\s+'), lambda x: x <> '')"


_SPEC = T.regex_class_escape(T.SPECIALS)


def _sql_spec(c):
    return (f"list_filter(regexp_extract_all(coalesce({c}, ''), '[^ \\t{_SPEC}]+|[{_SPEC}]'), "
            f"lambda x: NOT regexp_matches(x, '^[{_SPEC}]$'))")


def _sql_str(s):
    return "'" + s.replace("'", "''") + "'"


def _sql_vocab(words_cte: str, max_size: int, reserved) -> str:
    res = ", ".join(_sql_str(w) for w in reserved)
    vals = ", ".join(f"({_sql_str(w)}, {i})" for i, w in enumerate(reserved))
    return f"""cnt AS (SELECT word, count(*) AS freq FROM {words_cte} WHERE word NOT IN ({res}) GROUP BY word),
kept AS (SELECT * FROM cnt ORDER BY freq DESC, word LIMIT {max_size}),
voc AS (SELECT word, (row_number() OVER (ORDER BY word) + {len(reserved) - 1})::INT AS id, freq::BIGINT AS freq FROM kept
        UNION ALL SELECT word, id::INT, NULL::BIGINT FROM (VALUES {vals}) r(word, id))"""


SQL_PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS source, b.text AS target
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""

SQL_PAR_VOCAB = f"""{SQL_PAIRS},
pw AS (SELECT unnest({_sql_ws('source')}) AS word FROM pairs UNION ALL SELECT unnest({_sql_ws('target')}) FROM pairs),
{_sql_vocab('pw', PARALLEL_MAX, (C.UNK, C.EOS, C.GO))}"""

SQL_LINE_VOCAB = f"""lw AS (SELECT unnest({_sql_spec('text')}) AS word FROM conversations),
{_sql_vocab('lw', LINES_MAX, LINE_RESERVED)}"""


def _sql_encode(src: str, keys: str, tok_expr: str, name: str) -> str:
    return f"""{name}_t AS (SELECT {keys}, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos
    FROM (SELECT {keys}, {tok_expr} AS t FROM {src})),
{name}_e AS (SELECT {keys}, list(coalesce(voc.id, 0) ORDER BY pos) AS ids
    FROM {name}_t LEFT JOIN voc USING (word) WHERE pos < {ROW_SIZE - 1} GROUP BY {keys}),
{name} AS (SELECT {keys}, coalesce({name}_e.ids, []::INT[]) AS ids FROM {src} LEFT JOIN {name}_e USING ({keys}))"""


@register("build_vocab", f"WITH {SQL_PAR_VOCAB} SELECT word, id, freq FROM voc")
def build_vocab(spark, sf_dir):
    """Parallel-corpus vocabulary, top 2 000 000 words by frequency,
    ids alphabetical after <unk> <eos> <go>."""
    return _vocab_out(_parallel_vocab(spark, sf_dir))


@register("build_vocab_specials", f"WITH {SQL_LINE_VOCAB} SELECT word, id, freq FROM voc")
def build_vocab_specials(spark, sf_dir):
    """Line vocabulary, top 20 000 words, special characters reserved
    from id 3 on."""
    return _vocab_out(_line_vocab(spark, sf_dir))


def _encoded_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return C.encode_lines(lines, T.special_tokens(F.col("text")), _line_vocab(spark, sf_dir),
                          ["conv_id", "turn"], ROW_SIZE)


SQL_ENC_LINES = f"""{SQL_LINE_VOCAB},
{_sql_encode('conversations', 'conv_id, turn', _sql_spec('text'), 'enc')}"""


@register("encode_tokens", f"WITH {SQL_ENC_LINES} SELECT conv_id, turn, ids FROM enc")
def encode_tokens(spark, sf_dir):
    """Every conversation turn as at most 39 ids, unknown words → 0."""
    return _encoded_lines(spark, sf_dir)


@register("decode_ids", f"""WITH {SQL_ENC_LINES},
d AS (SELECT conv_id, turn, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM enc),
dt AS (SELECT conv_id, turn, string_agg(voc.word, ' ' ORDER BY pos) AS text FROM d JOIN voc USING (id) GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(dt.text, '') AS text FROM enc LEFT JOIN dt USING (conv_id, turn)""")
def decode_ids(spark, sf_dir):
    """The encoded turns decoded back to blank-joined words."""
    return C.decode(_encoded_lines(spark, sf_dir), _line_vocab(spark, sf_dir), ["conv_id", "turn"])


_EX_COLS = "input, target, decoder_input, input_len, target_len"


def _sql_examples(a: str, b: str) -> str:
    return (f"list_reverse({a}) AS input, list_concat({b}, [1]) AS target, list_concat([2], {b}) AS decoder_input, "
            f"len({a})::INT AS input_len, (len({b}) + 1)::INT AS target_len")


def _examples_out(df):
    return df.select("conv_id", "turn", *[F.col(c) for c in ("input", "target", "decoder_input")],
                     F.col("input_len").cast("int"), F.col("target_len").cast("int"))


@register("parallel_examples", f"""WITH {SQL_PAR_VOCAB},
{_sql_encode('pairs', 'conv_id, turn', _sql_ws('source'), 'es')},
{_sql_encode('pairs', 'conv_id, turn', _sql_ws('target'), 'et')}
SELECT conv_id, turn, {_sql_examples('es.ids', 'et.ids')} FROM es JOIN et USING (conv_id, turn)""")
def parallel_examples(spark, sf_dir):
    """T4: (reversed source ids, target ids + <eos>, <go> + target ids,
    lengths) for every user→assistant pair."""
    p = _pairs(spark, sf_dir)
    v = _parallel_vocab(spark, sf_dir)
    k = ["conv_id", "turn"]
    s = C.encode_lines(p, T.whitespace_tokens(F.col("source")), v, k, ROW_SIZE)
    t = C.encode_lines(p, T.whitespace_tokens(F.col("target")), v, k, ROW_SIZE).withColumnRenamed("ids", "tids")
    return _examples_out(s.join(t, k).select(*k, *C.seq2seq_rows(F.col("ids"), F.col("tids"))))


def _nextline(spark, sf_dir):
    e = _encoded_lines(spark, sf_dir)
    nxt = e.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("tids"))
    return e.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", *C.seq2seq_rows(F.col("ids"), F.col("tids")))


SQL_NEXTLINE = f"""{SQL_ENC_LINES},
nl AS (SELECT a.conv_id, a.turn, {_sql_examples('a.ids', 'b.ids')}
       FROM enc a JOIN enc b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@register("nextline_examples", f"WITH {SQL_NEXTLINE} SELECT * FROM nl")
def nextline_examples(spark, sf_dir):
    """T5: (turn i → turn i+1) examples inside each conversation."""
    return _examples_out(_nextline(spark, sf_dir))


@register("batch_numbers", f"""WITH {SQL_NEXTLINE},
o AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS row_id FROM nl),
n AS (SELECT count(*) AS n FROM nl)
SELECT conv_id, turn, row_id, ((row_id - 1) // {BATCH})::BIGINT AS batch, ((row_id - 1) // {BATCH} // {MACRO})::BIGINT AS macro_batch,
       ceil(n / {float(BATCH)})::BIGINT AS n_batches, ceil(ceil(n / {float(BATCH)}) / {float(MACRO)})::BIGINT AS n_macro_batches
FROM o CROSS JOIN n""")
def batch_numbers(spark, sf_dir):
    """Mini-batch (32) and macro-batch (20 mini-batches) numbers of the
    next-line examples in (conv_id, turn) order, with the totals."""
    nl = _nextline(spark, sf_dir).select("conv_id", "turn")
    o = C.global_ordinal(nl, [F.col("conv_id"), F.col("turn")], out="row_id")
    n = o.count()
    nb = -(-n // BATCH)
    b = F.floor((F.col("row_id") - 1) / BATCH)
    return o.select("conv_id", "turn", F.col("row_id").cast("long"), b.cast("long").alias("batch"),
                    F.floor(b / MACRO).cast("long").alias("macro_batch"), F.lit(nb).cast("long").alias("n_batches"),
                    F.lit(-(-nb // MACRO)).cast("long").alias("n_macro_batches"))


@register("interleave_pairs", f"""WITH {SQL_PAIRS}
SELECT conv_id, turn, 0::INT AS side, source AS line FROM pairs
UNION ALL SELECT conv_id, turn, 1::INT AS side, target AS line FROM pairs""")
def interleave_pairs(spark, sf_dir):
    """The parallel pairs read out as interleaved lines (source, target)."""
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "turn", F.posexplode(F.array("source", "target")).alias("side", "line")).select(
        "conv_id", "turn", F.col("side").cast("int"), "line")


WINDOW_LEN = 100

_CF = ("a-zA-Z0-9" + T.regex_class_escape(T.CHAR_FILTER_EXTRA)).replace("'", "''")


@register("char_windows", f"""WITH f AS (SELECT string_agg(regexp_replace(coalesce(text, ''), '[^{_CF}]', '', 'g') || chr(10), ''
    ORDER BY doc_id) AS s FROM documents),
n AS (SELECT s, length(s) AS n FROM f)
SELECT i::BIGINT AS window_id, substr(s, i * {WINDOW_LEN} + 1, {WINDOW_LEN - 1}) AS input,
       substr(s, i * {WINDOW_LEN} + 2, {WINDOW_LEN - 1}) AS target
FROM n, range(0, greatest((n - 1) // {WINDOW_LEN} - 2, 0)) r(i)""")
def char_windows(spark, sf_dir):
    """Character-model training windows of 100 characters over the
    filtered documents (77-character set), in doc_id order."""
    d = tbl(spark, sf_dir, "documents").select("doc_id", T.char_filter(F.col("text")).alias("text"))
    return C.char_windows(d, WINDOW_LEN).select("window_id", "input", "target")
