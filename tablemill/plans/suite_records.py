"""Registered queries over records: reading, curation, repair, preparation, scoring.

Each entry is name -> (query over the driver's tables, the same in SQL or None).
"""

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..operators import curation, evaluate, prepare, rank, repair
from ..session import new_folder
from ..sources import generated, records, tables
from . import stand_ins as given
from .stand_ins import EXCHANGES, LOSS_LOG, RECORDS, SCORES, TOOL, TWO_MODELS



# The same characters as a class of a regular expression.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(value: str) -> str:
    return f"regexp_replace(coalesce({value}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


STATUS = f"lower({stripped('status')})"
MODE = "case " + " ".join(
    "when contains(error, '{0}') then '{0}'".format(m.replace("'", "''")) for m in curation.FAILURE_MODES
) + " end"
MODES = "(values " + ", ".join(
    "({0}, '{1}')".format(i, m.replace("'", "''")) for i, m in enumerate(curation.FAILURE_MODES)
) + ") as m(place, mode)"
REPAIRED = ", ".join("'" + s.replace("'", "''") + "'" for s in curation.repaired_statuses(TOOL))
NO_PREFIX = curation.skipped_without_prefix(TOOL).replace("'", "''")

QUERIES = {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


# --- sources and sinks: what is written is derived from the given tables, read back and compared --------


def _corpus(spark, folder):
    return given.records(spark, folder).select(
        "prompt", F.col("cmd").alias("response"), "status", "error", "cmd", F.col("file").alias("source_cmd_file")
    )


CORPUS = f"(select prompt, cmd as response, status, error, cmd, file as source_cmd_file from {RECORDS})"


@query(f"select * from {CORPUS}")
def read_json_corpus(spark, folder):
    place = new_folder(spark, "corpus")
    records.write_record_arrays(_corpus(spark, folder), place, per_file=200)
    return records.read_corpus_trusted(spark, place, place + "-missing", pattern="*").drop("file", "path")


@query(f"select * from {CORPUS}")
def read_json_corpus_tolerant(spark, folder):
    """Files of good arrays, some elements of which are no objects, next to files that are broken in six ways.

    All are whole files that no task splits, so they are compressed: the corpus is written eight times.
    """
    place = new_folder(spark, "corpus")
    records.write_record_arrays(_corpus(spark, folder), f"{place}/plain", per_file=200, compression="gzip")
    whole = spark.read.text(f"{place}/plain", wholetext=True).select(F.trim(F.translate("value", "\n", " ")).alias("value"))
    inner = F.expr("substring(value, 2, length(value) - 2)")
    stray = F.concat(F.lit('[1, "text", null, [2], "{\\"prompt\\": \\"no\\"}", '), inner, F.lit("]"))
    broken = [
        F.concat("value", F.lit(" junk")), F.concat("value", "value"), F.concat("value", F.lit("]")), F.concat("value", F.lit("}")),
        F.concat(F.lit('{"all": '), "value", F.lit("}")), F.expr("left(value, length(value) - 3)"),
    ]
    for name, texts in (("good", [stray]), ("broken", broken)):
        files = whole.select(F.explode(F.array(*texts)).alias("value"))
        files.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(f"{place}/{name}")
    return records.read_corpus(spark, f"{place}/good", f"{place}/broken", f"{place}/missing", pattern="*.txt.gz").drop("file", "path")


@query(f"select prompt, cmd, status from {RECORDS}")
def write_json_records(spark, folder):
    place = new_folder(spark, "records")
    records.write_records(given.records(spark, folder).select("prompt", "cmd", "status"), place)
    return spark.read.schema("prompt STRING, cmd STRING, status STRING").json(place)


@query(
    f"select doc_id, cast(i - 1 as integer) as line_no, lines[i] as line from (select doc_id, string_split_regex(text, '{text.LINE_END}') as lines, "
    f"unnest(generate_series(1, len(string_split_regex(text, '{text.LINE_END}')))) as i from documents)"
)
def document_lines(spark, folder):
    return records.text_lines(given.table(spark, folder, "documents"), "doc_id")


@query(
    f"select line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) group by line"
)
def read_text_lines(spark, folder):
    place = new_folder(spark, "lines")
    given.table(spark, folder, "documents").select("text").write.option("lineSep", "\n").text(place)
    return records.read_lines(spark, place).groupBy(F.col("text").alias("line")).agg(F.count("*").alias("n"))


@query(f"select step, loss from {LOSS_LOG} where loss is not null")
def csv_metrics(spark, folder):
    place = new_folder(spark, "metrics")
    records.write_metrics(evaluate.loss_curve(given.loss_log(spark, folder)), place)
    return records.read_metrics(spark, place)


@query(
    "select p as prompt, r as response from (select " + stripped("prompt") + " as p, " + stripped("response")
    + f" as r from {EXCHANGES}) where p <> '' or r <> ''"
)
def xml_examples(spark, folder):
    place = new_folder(spark, "examples")
    records.write_examples(given.exchanges(spark, folder), place)
    return records.read_examples(spark, place)


# The given pages hold four entities and no ruby notes or templates, so patterns can find their text.
PAGE_TEXT = (
    r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<[^>]*>', '', 'g')"
)
for _entity, _character in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    PAGE_TEXT = f"replace({PAGE_TEXT}, '{_entity}', '{_character}')"


@query(
    "select page_id, array_to_string(list_filter(list_transform(string_split_regex(" + PAGE_TEXT + ", '" + text.LINE_END + "'), lambda l: "
    + stripped("l") + "), lambda l: l <> ''), chr(10)) as text from pages"
)
def html_pages_to_text(spark, folder):
    return given.spread_table(spark, folder, "pages", "page_id", "html").select("page_id", records.html_text("html").alias("text"))


@query(
    "select doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '" + text.LINE_END + "'), lambda l: "
    + stripped("l") + "), lambda l: l <> ''), chr(10)) as text from documents"
)
def clean_document_lines(spark, folder):
    return given.spread_table(spark, folder, "documents", "doc_id", "text").select("doc_id", text.clean_lines("text").alias("text"))


@query(
    """with d as (select c_custkey, md5('1:' || c_custkey) as m1, md5('2:' || c_custkey) as m2 from customer)
    select c_custkey, round(('0x' || m1[1:13])::bigint / 4503599627370496e0 * 360e0, 6) as ra,
    round(degrees(asin(('0x' || m2[1:13])::bigint / 4503599627370496e0 * 2e0 - 1e0)), 6) as dec from d"""
)
def simulated_sky(spark, folder):
    sky = generated.simulated_sky(given.table(spark, folder, "customer"), "c_custkey")
    return sky.select("c_custkey", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("select i, o_orderstatus from (select unnest(generate_series(1, (select max(o_orderkey) from orders), 3)) as i) join orders on o_orderkey = i")
def loop_rows(spark, folder):
    """A loop by threes up to the largest order, and the orders it meets."""
    orders = given.table(spark, folder, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    return generated.loop_table(spark, 1, (last or 0) + 1, 3).join(orders, F.col("i") == F.col("o_orderkey")).select("i", "o_orderstatus")


@query("select o_orderkey, o_orderstatus, o_totalprice, o_orderdate from orders")
def convert_formats(spark, folder):
    """CSV, then TSV, JSON, ORC and Parquet, each converted from the one before."""
    schema = "o_orderkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP"
    first = given.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    place = new_folder(spark, "formats")
    tables.write_table(first, f"{place}/csv", "csv")
    chain = ["csv", "tsv", "json", "orc", "parquet"]
    for before, after in zip(chain, chain[1:]):
        tables.convert(spark, f"{place}/{before}", before, f"{place}/{after}", after, schema)
    return tables.read_table(spark, f"{place}/parquet", "parquet", schema)


# --- statuses, failures, repairs ---------------------------------------------------------------------


@query(
    "select page_id, case when base ~ '^.*[^.].*\\.[^.]*$' then regexp_replace(base, '\\.[^.]*$', '') else base end as cmd "
    "from (select page_id, regexp_replace(url, '^.*/', '') as base from pages)"
)
def tag_with_file_stem(spark, folder):
    return curation.tag_with_file(given.table(spark, folder, "pages"), "url").select("page_id", "cmd")


@query(f"select rid, {STATUS} as status from {RECORDS}")
def normalised_status(spark, folder):
    return given.records(spark, folder).select("rid", curation.normalise_status("status").alias("status"))


@query(f"select rid, cmd, error from {RECORDS} where status = 'failed'")
def failed_records(spark, folder):
    return curation.failed_rows(given.records(spark, folder)).select("rid", "cmd", "error")


COMMANDS = f"""(select rid, case when starts_with(prompt, '{TOOL}') then null else '{NO_PREFIX}' end as status,
  case when starts_with(prompt, '{TOOL}') then """ + stripped(
    f"replace(replace(prompt, 'java -jar {TOOL}.jar', ''), '{TOOL}', '')"
) + f" end as command from {RECORDS})"


@query(f"select * from {COMMANDS}")
def gate_and_clean_commands(spark, folder):
    return curation.gate_commands(given.records(spark, folder), TOOL, "prompt").select("rid", "status", "command")


def word_count_checker(commands: pd.Series) -> pd.Series:
    """Stands in for a real syntax check: a command with an odd number of characters is wrong."""
    odd = commands.str.len() % 2 == 1
    return commands.where(odd, None).map(lambda c: f"Error: Row count {len(c)}", na_action="ignore")


@query(
    f"""select rid, case when command is null then status when length(command) % 2 = 1 then 'failed' else 'executed successfully' end as status,
    case when command is not null and length(command) % 2 = 1 then 'Error: Row count ' || length(command) end as error from {COMMANDS}"""
)
def validate_commands(spark, folder):
    gated = curation.gate_commands(given.records(spark, folder).select("rid", "prompt"), TOOL, "prompt")
    return curation.validate(gated.select("rid", "status", "command"), word_count_checker).select("rid", "status", "error")


@query(
    f"""select c.rid, case when c.command is null or l.doc_id is null then c.status when l.quality = 0 then 'failed' else 'executed successfully' end as status,
    case when c.command is not null and l.quality = 0 then 'Error: Bad Expression' end as error
    from {COMMANDS} c left join labels l on l.doc_id = c.rid"""
)
def apply_check_results(spark, folder):
    gated = curation.gate_commands(given.records(spark, folder), TOOL, "prompt").withColumn("error", F.lit(None).cast("string"))
    results = given.table(spark, folder, "labels").select(
        F.col("doc_id").alias("rid"), F.when(F.col("quality") == 0, "Error: Bad Expression").alias("error")
    )
    return curation.apply_results(gated, results, "rid").select("rid", "status", "error")


@query(f"select rid, {MODE} as mode from {RECORDS}")
def classify_errors(spark, folder):
    return given.records(spark, folder).select("rid", curation.classify_error("error").alias("mode"))


@query(
    f"""select cast(m.place as integer) as place, m.mode, count(f.mode) as n from {MODES}
    left join (select {MODE} as mode from {RECORDS} where status = 'failed') f on f.mode = m.mode group by m.place, m.mode"""
)
def failure_mode_counts(spark, folder):
    return curation.failure_counts(given.records(spark, folder))


REPAIR_SQL = """select p_partkey,
  'in=' || p_brand || ' ' || n || '=''' ||
  'addcol ' || p_brand || ' "' || p_type || '"; ' ||
  'keepcols "' || p_name || '"; sort; select "x > 1"; addcol "one"' || ''' out=o' as response
from (select *, ['cmd','ocmd','icmd3'][1 + p_partkey % 3] as n from part)"""


def _broken_commands(spark, folder, between="='"):
    name = F.element_at(F.array(F.lit("cmd"), F.lit("ocmd"), F.lit("icmd3")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return given.table(spark, folder, "part").select(
        "p_partkey",
        F.concat(
            F.lit("in="), "p_brand", F.lit(" "), name, F.lit(between + "addcol "), "p_brand", F.lit(" "), "p_type",
            F.lit(";keepcols  "), F.lit(" "), "p_name", F.lit(' ; sort; select "x > 1";addcol one\' out=o'),
        ).alias("response"),
    )


@query(REPAIR_SQL.replace('\'keepcols "\' || p_name', '\'keepcols "  \' || p_name'))
def quote_repair(spark, folder):
    return _broken_commands(spark, folder).select("p_partkey", repair.quote_arguments("response").alias("response"))


@query(
    """select p_partkey, case when p_size > 25 then 'cmd=''select x'' ocmd= ''sort ' || p_name || ' up'''
    else n || '=''sort "' || p_name || ' up"; head' || ''' x=1' end as response
    from (select *, ['cmd','ocmd','icmd3'][1 + p_partkey % 3] as n from part)"""
)
def quote_repair_spaced(spark, folder):
    part = given.table(spark, folder, "part")
    name = F.element_at(F.array(F.lit("cmd"), F.lit("ocmd"), F.lit("icmd3")), (F.col("p_partkey") % 3 + 1).cast("int"))
    response = F.when(
        F.col("p_size") > 25, F.concat(F.lit("cmd='select x' ocmd= 'sort "), "p_name", F.lit(" up'"))
    ).otherwise(F.concat(name, F.lit("= 'sort "), "p_name", F.lit(" up;head' x=1")))
    return part.select("p_partkey", repair.quote_spaced_arguments(response).alias("response"))


@query(
    """select o_orderkey, case o_orderkey % 5 when 0 then o_orderpriority || ' (x' when 1 then 'order ' || o_orderstatus
    when 2 then o_orderpriority when 3 then null else null end as description from orders"""
)
def extract_tool_calls(spark, folder):
    kind, what = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    call = (
        F.when(kind == 0, F.concat(F.lit("[make_command(properties='"), what, F.lit(" (x')] type='no')")))
        .when(kind == 1, F.concat(F.lit('[make_command(description="order '), "o_orderstatus", F.lit('")] more)')))
        .when(kind == 2, F.concat(F.lit("make_command type='"), what))
        .when(kind == 3, F.concat(F.lit("make_command "), what))
        .otherwise(F.concat(F.lit("other(properties='"), what, F.lit("')")))
    )
    orders = given.table(spark, folder, "orders")
    return orders.select("o_orderkey", repair.extract_tool_call(call, "make_command").alias("description"))


@query(
    f"select rid, case when contains(prompt, ' ') then {stripped("string_split(prompt, ' ')[2]")} end as answer from {RECORDS}"
)
def extract_answers(spark, folder):
    """The text between the first two blanks stands for that between two role markers."""
    return given.records(spark, folder).select("rid", repair.extract_answer("prompt", " ").alias("answer"))


# --- templates, tokens, blocks -----------------------------------------------------------------------



def turn_sql(role: str, content: str) -> str:
    return f"'<start_of_turn>' || {role} || chr(10) || {stripped(content)} || '<end_of_turn>' || chr(10)"


@query(
    "select conv_id, turn, '<bos>' || " + turn_sql("'user'", "prompt") + " || " + turn_sql("'assistant'", "response")
    + f" as text from {EXCHANGES}"
)
def chat_records(spark, folder):
    return given.exchanges(spark, folder).select("conv_id", "turn", prepare.render_record().alias("text"))


CHAT = (
    "with c as (select conv_id, cast(0 as bigint) as part, count(*) as turns, min_by(role, turn) = 'system' as rejected, "
    "'<bos>' || string_agg(" + turn_sql("role", "text") + ", '' order by turn) || '<start_of_turn>model' || chr(10) as text "
    "from conversations group by conv_id) select conv_id, part, turns, rejected, case when not rejected then text end as text from c"
)


@query(CHAT)
def chat_conversations(spark, folder):
    return prepare.render_conversations(given.table(spark, folder, "conversations"), generation=True)


@query(
    "select conv_id, turn, (select min_by(role, turn) from conversations f where f.conv_id = c.conv_id) = 'system' as rejected, "
    "case when (select min_by(role, turn) from conversations f where f.conv_id = c.conv_id) <> 'system' then "
    "case when turn = (select min(turn) from conversations f where f.conv_id = c.conv_id) then '<bos>' else '' end || "
    + turn_sql("role", "text") + " end as piece from conversations c"
)
def chat_turns(spark, folder):
    turns = prepare.render_turns(given.table(spark, folder, "conversations"))
    return turns.select("conv_id", "turn", "rejected", "piece")


@query(
    "select doc_id, '<bos><start_of_turn>user' || chr(10) || text || '<end_of_turn>' || chr(10) || '<start_of_turn>assistant' || chr(10) as prompt from documents"
)
def inference_prompts(spark, folder):
    return given.table(spark, folder, "documents").select("doc_id", prepare.inference_prompt("text").alias("prompt"))


WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"


@query(
    "select doc_id, len(w) as tokens, md5(array_to_string(w, chr(10))) as digest from (select doc_id, "
    + WORDS.format("text") + " as w from documents)"
)
def word_tokens(spark, folder):
    documents = given.spread_table(spark, folder, "documents", "doc_id", "text")
    words = documents.select("doc_id", prepare.word_tokens("text").alias("w"))
    return words.select(
        "doc_id", F.size("w").cast("long").alias("tokens"), F.md5(F.array_join("w", "\n")).alias("digest")
    )


def code_point_tokenizer(texts: pd.Series) -> pd.Series:
    """A stand-in for a model's tokenizer: one token per character."""
    return texts.map(lambda t: [ord(c) for c in t])


@query("select doc_id, length(text) as tokens, unicode(left(text, 1)) as first_id from documents")
def batched_tokenizer(spark, folder):
    documents = given.spread_table(spark, folder, "documents", "doc_id", "text")
    tokens = prepare.tokenise(documents, code_point_tokenizer)
    # As in the SQL, the code point of an empty text is -1.
    first = F.when(F.array_size("input_ids") == 0, -1).otherwise(F.get("input_ids", F.lit(0)))
    return tokens.select("doc_id", F.array_size("attention_mask").cast("long").alias("tokens"), first.alias("first_id"))


BLOCK = 1024
PACK = (
    "with b as (select doc_id, (row_number() over (order by doc_id) - 1) // 100 as batch_id, " + WORDS.format("text") + " as w from documents), "
    "c as (select batch_id, flatten(list(w order by doc_id)) as w from b group by batch_id), "
    f"k as (select batch_id, w, unnest(generate_series(0, case when len(w) >= {BLOCK} then len(w) // {BLOCK} - 1 else 0 end)) as block_id from c where len(w) > 0) "
    f"select batch_id, block_id, len(p) as tokens, md5(array_to_string(p, ' ')) as digest, md5(array_to_string(p, ' ')) as label_digest "
    f"from (select batch_id, block_id, w[block_id * {BLOCK} + 1:(block_id + 1) * {BLOCK}] as p from k)"
)


@query(PACK)
def packed_blocks(spark, folder):
    documents = given.table(spark, folder, "documents").select("doc_id", "text")
    blocks = prepare.pack_rows(documents, "doc_id", prepare.word_tokens("text"), BLOCK, 100)
    return blocks.select(
        "batch_id", "block_id", F.size("input_ids").cast("long").alias("tokens"),
        F.md5(F.array_join("input_ids", " ")).alias("digest"), F.md5(F.array_join("labels", " ")).alias("label_digest"),
    )


@query(f"select rid, cmd, upper(cmd) as generated, 0.5::double as score from {RECORDS}")
def merge_record_fields(spark, folder):
    cases = given.records(spark, folder).select("rid", "cmd")
    return prepare.merge_fields(cases, generated=F.upper("cmd"), score=F.lit(0.5))


# --- joins, unions, order, split ------------------------------------------------------------------------

KEYS = ["src1", "src2", "src10", "src12", "absent"]


@query(
    "with f as (select distinct source || '.json' as file from documents), k as (select unnest(["
    + ", ".join(f"'{k}'" for k in KEYS) + "]) as key) select file, key from f join k on contains(file, key)"
)
def files_by_key(spark, folder):
    files = given.table(spark, folder, "documents").select(F.concat("source", F.lit(".json")).alias("file")).distinct()
    return curation.files_per_key(files, KEYS)


ENTRIES = (
    "with k as (select * from (values " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYS)) + ") as k(place, key)), "
    "c as (select k.place, k.key, count(d.doc_id) as n from k left join documents d on contains(d.source || '.json', k.key) group by k.place, k.key) "
    f"select cast(place as integer) as place, key, n from c union all select {len(KEYS)}, 'total', cast(sum(n) as bigint) from c"
)


@query(ENTRIES)
def entries_per_command(spark, folder):
    files = given.table(spark, folder, "documents").select(F.concat("source", F.lit(".json")).alias("file"))
    return curation.entries_per_key(files, KEYS)


# The two corpora of the funnel: all records as generated, and the failed ones after their repair.
FIXED = f"(select rid, cmd, case rid % 4 when 0 then 'fixed' when 1 then 'FAILED ' when 2 then 'fixed: by hand' else 'skipped-plot' end as status from {RECORDS} where status = 'failed')"


def _repaired(spark, folder):
    kind = F.col("rid") % 4
    status = (
        F.when(kind == 0, "fixed").when(kind == 1, "FAILED ").when(kind == 2, "fixed: by hand").otherwise("skipped-plot")
    )
    return curation.failed_rows(given.records(spark, folder)).select("rid", "cmd", status.alias("status"))


ADMITTED = (
    f"(select rid, cmd, status from {RECORDS} where {STATUS} <> 'failed' union all "
    f"select rid, cmd, status from {FIXED} where {STATUS} in ({REPAIRED}))"
)


@query(f"select rid, cmd, status from {ADMITTED}")
def admitted_records(spark, folder):
    main = given.records(spark, folder).select("rid", "cmd", "status")
    return curation.admit(main, _repaired(spark, folder), TOOL)


@query(f"select rid, cmd, status, error from {RECORDS} union all select rid, cmd, status, null from {FIXED}")
def concatenated_corpora(spark, folder):
    main = given.records(spark, folder).select("rid", "cmd", "status", "error")
    return curation.concatenate(main, _repaired(spark, folder))


HELD_OUT = (
    "(select doc_id, row_number() over (order by ('0x' || md5('7:' || doc_id)[1:15])::bigint, doc_id) as place, count(*) over () as n from documents)"
)


@query(f"select doc_id, case when place <= floor(n * 0.1) then 'test' else 'train' end as part from {HELD_OUT}")
def holdout_parts(spark, folder):
    documents = given.table(spark, folder, "documents").select("doc_id")
    train, test = curation.holdout_split(documents, "doc_id", 0.1, seed=7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("select doc_id, row_number() over (order by md5('42:' || doc_id::varchar), doc_id) as place from documents")
def seeded_shuffle(spark, folder):
    return rank.number_sorted(curation.shuffle_rows(given.table(spark, folder, "documents").select("doc_id"), "doc_id"), "place")


@query(
    f"select rid, cmd, row_number() over (order by cmd, rid) as place from {RECORDS}"
)
def ordered_report(spark, folder):
    report = given.records(spark, folder).select("rid", "cmd")
    return rank.number_sorted(curation.ordered_report(report, "cmd", "rid"), "place")


@query("select doc_id, case when length(text) > 500 then left(text, 500) || '...' else text end as text from documents order by doc_id limit 2")
def sample_texts(spark, folder):
    return curation.sample_texts(given.table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


@query(f"select distinct {STATUS} as status from {RECORDS}")
def distinct_statuses(spark, folder):
    return curation.distinct_statuses(given.records(spark, folder))


@query(
    f"""select rid, mode, regexp_replace(mode, '[^\\p{{L}}\\p{{N}}]', '_', 'g') as mode_key, file as source_cmd_file
    from (select *, {MODE} as mode from {RECORDS} where status = 'failed') where mode is not null"""
)
def failures_by_mode(spark, folder):
    """Written to one folder per mode, and read back with the mode from the folder's name."""
    failures = curation.failures_by_mode(given.records(spark, folder)).select("rid", "mode", "mode_key", "source_cmd_file")
    place = new_folder(spark, "failures")
    records.write_failures(failures, place)
    return spark.read.schema(failures.schema).json(place)


# --- reports ---------------------------------------------------------------------------------------


@query(
    f"""select file, count(*) as total, count(*) filter (status = 'failed') as failed,
    printf('%.2f%%', count(*) filter (status = 'failed') / count(*) * 100) as failure_percentage from {RECORDS} group by file"""
)
def quality_by_file(spark, folder):
    return curation.quality_by_file(given.records(spark, folder))


VALIDITY = f"""(select file, count(*) as total, count(*) filter (status = 'failed') as failed,
  count(*) filter (status = 'executed successfully') as success,
  count(*) filter (status is null or status not in ('failed', 'executed successfully')) as other,
  round(count(*) filter (status = 'executed successfully') / count(*) * 100, 6) as valid_rate
  from (select file, case when rid % 3 = 0 then trim(lower(status)) else status end as status from {RECORDS}) group by file)"""


def _validity(spark, folder):
    status = F.when(F.col("rid") % 3 == 0, F.trim(F.lower("status"))).otherwise(F.col("status"))
    return curation.validity_by_file(given.records(spark, folder).withColumn("status", status)).withColumn(
        "valid_rate", F.round("valid_rate", 6)
    )


@query(f"select * from {VALIDITY}")
def validity_by_file(spark, folder):
    return _validity(spark, folder)


@query(f"select round(avg(valid_rate), 6) as mean_valid_rate from {VALIDITY}")
def mean_validity(spark, folder):
    return curation.mean_validity(_validity(spark, folder)).select(F.round("mean_valid_rate", 6).alias("mean_valid_rate"))


FUNNEL = f"""(with t as (select cmd, {STATUS} as s, true as main from {RECORDS} union all select cmd, {STATUS}, false from {FIXED}),
  g as (select cmd, count(*) filter (main and s in ('executed successfully', '{NO_PREFIX}')) as success,
    count(*) filter (main and s = 'failed') as failure, count(*) filter (not main and s in ({REPAIRED})) as fixed,
    count(*) filter (not main and s = 'failed') as unrepaired from t where cmd <> '' group by cmd)
  select cmd, success + failure as total, failure, success, unrepaired + failure - fixed as removed, fixed, success + fixed as final,
    case when success + failure > 0 then round((success + fixed) / (success + failure) * 100, 6) else 0.0 end as success_rate
  from g where success + failure + fixed + unrepaired > 0)"""


def _funnel(spark, folder):
    return curation.funnel(given.records(spark, folder), _repaired(spark, folder), TOOL)


@query(f"select * from {FUNNEL}")
def curation_funnel(spark, folder):
    return _funnel(spark, folder).withColumn("success_rate", F.round("success_rate", 6))


@query(
    f"""select cast(sum(total) as bigint) as total_generated, cast(sum(final) as bigint) as total_training,
    cast(sum(failure - fixed) as bigint) as total_removed, cast(sum(fixed) as bigint) as total_fixed, cast(sum(failure) as bigint) as total_failed,
    round(sum(final) / sum(total) * 100, 6) as overall_success_rate from {FUNNEL}"""
)
def funnel_totals(spark, folder):
    totals = curation.funnel_totals(_funnel(spark, folder))
    return totals.withColumn("overall_success_rate", F.round("overall_success_rate", 6))


# --- scores and losses -----------------------------------------------------------------------------


@query(f"select * from {SCORES}")
def cosine_scores(spark, folder):
    return given.scores(spark, folder)


def length_embedder(texts: pd.Series) -> pd.Series:
    """A stand-in for a sentence embedding: lengths and vowel counts."""
    return texts.map(lambda t: [float(len(t)), float(sum(t.count(v) for v in "aeiou")), 1.0])


def _vector(column):
    return f"[length({column}), length({column}) - length(regexp_replace({column}, '[aeiou]', '', 'g')), 1]::double[]"


@query(
    f"select conv_id, turn, round(list_cosine_similarity({_vector('g')}, {_vector('response')}), 6) as score "
    f"from (select *, lower(prompt) as g from {EXCHANGES})"
)
def generated_and_scored(spark, folder):
    """The whole evaluation: a stand-in model answers, a stand-in embedder scores."""
    cases = given.exchanges(spark, folder)
    answered = evaluate.generate(cases, lambda prompts, **settings: prompts.str.lower())
    scored = evaluate.score_answers(answered, length_embedder)
    return scored.select("conv_id", "turn", F.round("score", 6).alias("score"))


@query(f"select vec_id, category, score from {SCORES} where score < 0.95")
def low_scores(spark, folder):
    return evaluate.low_scores(given.scores(spark, folder), 0.95, "vec_id")


@query(
    f"select category, count(*) as cases, round(avg(score) * 100, 6) as mean_percent, round(stddev_pop(score), 6) as std from {SCORES} group by category"
)
def category_summary(spark, folder):
    return evaluate.summary(given.scores(spark, folder), "category").select(
        "category", "cases", F.round("mean_percent", 6).alias("mean_percent"), F.round("std", 6).alias("std")
    )


@query(f"select count(*) as cases, round(avg(score) * 100, 6) as mean_percent, round(stddev_pop(score), 6) as std from {SCORES}")
def overall_summary(spark, folder):
    return evaluate.summary(given.scores(spark, folder)).select(
        "cases", F.round("mean_percent", 6).alias("mean_percent"), F.round("std", 6).alias("std")
    )


@query(
    f"""with c as (select category, model, cast(least(floor(score * 10), 9) as integer) as bin from {TWO_MODELS} where score between 0 and 1),
    f as (select category, unnest(generate_series(0, 9)) as bin from (select distinct category from {SCORES}))
    select f.category, cast(f.bin as integer) as bin, count(*) filter (model = 'a') as n_a, count(*) filter (model = 'b') as n_b
    from f left join c on c.category = f.category and c.bin = f.bin group by f.category, f.bin"""
)
def category_histogram(spark, folder):
    both = given.two_models(spark, folder)
    return evaluate.histogram(both, 10, "category", both.where("model = 'a'"))


@query(
    f"""with c as (select model, least(floor(score * 20), 19) as bin from {TWO_MODELS} where score between 0 and 1)
    select cast(f.bin as integer) as bin, count(*) filter (model = 'a') as n_a, count(*) filter (model = 'b') as n_b
    from generate_series(0, 19) as f(bin) left join c on c.bin = f.bin group by f.bin"""
)
def overall_histogram(spark, folder):
    return evaluate.histogram(given.two_models(spark, folder), 20)


@query(f"select model, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std from {TWO_MODELS} group by model")
def model_comparison(spark, folder):
    compared = evaluate.compare_models(given.two_models(spark, folder))
    return compared.select("model", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    f"select 'train' as curve, step, loss from {LOSS_LOG} where loss is not null union all select 'eval', step, eval_loss from {LOSS_LOG} where eval_loss is not null"
)
def loss_curves(spark, folder):
    log = given.loss_log(spark, folder)
    train = evaluate.loss_curve(log).select(F.lit("train").alias("curve"), "step", "loss")
    return train.unionByName(evaluate.loss_curve(log, "eval_loss").select(F.lit("eval").alias("curve"), "step", "loss"))


@query(f"select eval_loss as loss, step from {LOSS_LOG} where eval_loss is not null order by eval_loss, step limit 1")
def best_step(spark, folder):
    return evaluate.best_step(evaluate.loss_curve(given.loss_log(spark, folder), "eval_loss"))
