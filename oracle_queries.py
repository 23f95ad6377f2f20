"""DuckDB statements that every registered query must equal.

They restate the semantics independently of the Spark plans: repeats list all pairs of equal
seeds and extend them as runs on a diagonal, the greedy choice and pruning are recursive.
"""

CONTEXT = 1024

DOCS = """docs AS MATERIALIZED (SELECT doc_id AS record_id,
  regexp_replace(upper(text), '[^ACGTN]+', '', 'g') AS seq FROM documents)"""
PACKED = """docs AS MATERIALIZED (SELECT doc_id AS record_id,
  regexp_replace(upper(text), '[^ACGT]+', '', 'g') AS seq FROM documents)"""
PAGES = """docs AS MATERIALIZED (SELECT page_id AS record_id,
  regexp_replace(upper(html), '[^ACGTN]+', '', 'g') AS seq FROM pages)"""


def kmers(k: int, name: str = "km") -> str:
    return f"""{name} AS MATERIALIZED (SELECT record_id, n, pos, substr(seq, pos + 1, {k}) AS kmer
  FROM (SELECT record_id, seq, length(seq) AS n, unnest(range(length(seq) - {k} + 1)) AS pos
        FROM docs WHERE length(seq) >= {k}))"""


def best(k: int, shortest: int, overlap: bool = False) -> str:
    keep = "" if overlap else f"AND a.pos - b.pos >= {shortest}"
    return f"""{kmers(k)},
pairs AS (SELECT a.record_id, a.n, a.pos AS start, b.pos AS source, a.pos - b.pos AS d
  FROM km a JOIN km b ON a.record_id = b.record_id AND a.kmer = b.kmer AND b.pos < a.pos {keep}),
isl AS (SELECT *, start - row_number() OVER (PARTITION BY record_id, d ORDER BY start) AS g
  FROM pairs),
ext AS (SELECT record_id, start, source, greatest({k}, least(
    {k} + max(start) OVER (PARTITION BY record_id, d, g) - start, d)) AS length FROM isl),
ranked AS (SELECT *, row_number() OVER (
    PARTITION BY record_id, start ORDER BY length DESC, source) AS rn FROM ext),
best AS MATERIALIZED (SELECT record_id, start, source, length FROM ranked
  WHERE rn = 1 AND length >= {shortest})"""


PICK = """pick AS (
  SELECT record_id, start, source, length FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY start) AS rn FROM best)
  WHERE rn = 1
  UNION ALL
  SELECT record_id, start, source, length FROM (
    SELECT b.*, row_number() OVER (PARTITION BY b.record_id ORDER BY b.start) AS rn
    FROM pick p JOIN best b ON b.record_id = p.record_id AND b.start >= p.start + p.length)
  WHERE rn = 1)"""


def repeats(source: str, k: int = 15, shortest: int = 40, overlap: bool = False) -> str:
    return f"WITH RECURSIVE {source}, {best(k, shortest, overlap)}, {PICK}"


def spans(copies: str) -> str:
    """Tiling of every record: copies, the gaps before them and the rest."""
    return f"""gaps AS (
  SELECT record_id, prev AS start, start - prev AS length FROM (
    SELECT record_id, start, lag(start + length, 1, 0) OVER (
      PARTITION BY record_id ORDER BY start) AS prev FROM {copies}) WHERE start > prev
  UNION ALL
  SELECT d.record_id, coalesce(e.last, 0), length(d.seq) - coalesce(e.last, 0)
  FROM docs d LEFT JOIN (SELECT record_id, max(start + length) AS last FROM {copies}
    GROUP BY record_id) e USING (record_id)
  WHERE length(d.seq) > coalesce(e.last, 0))"""


def model_blocks(copies: str, name: str = "blk") -> str:
    """Blocks of the model family: gaps in chunks of CONTEXT, short ones raw."""
    return f"""{spans(copies)},
{name} AS MATERIALIZED (
  SELECT record_id, 'graph_copy' AS type, start, length, source, false AS use_context
  FROM {copies}
  UNION ALL
  SELECT record_id, CASE WHEN size < 64 THEN 'raw_residual' ELSE 'llm_residual' END, p, size,
    NULL, size >= 64 AND p > 0
  FROM (SELECT record_id, p, least({CONTEXT}, start + length - p) AS size
    FROM (SELECT record_id, start, length,
      unnest(range(start, start + length, {CONTEXT})) AS p FROM gaps)))"""


PLAIN_BLOCKS = f"""{spans('pick')},
blk AS (
  SELECT record_id, 'graph_copy' AS type, start, length, source, 0 AS payload_length FROM pick
  UNION ALL
  SELECT record_id, 'llm_residual', start, length, NULL, length FROM gaps),
numbered AS MATERIALIZED (
  SELECT b.*, row_number() OVER w - 1 AS block_no,
    CAST(coalesce(sum(payload_length) OVER (PARTITION BY record_id ORDER BY start
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS payload_offset
  FROM blk b WINDOW w AS (PARTITION BY record_id ORDER BY start))"""

# state of one pruning pass: the list, the place in it, the end of the last kept copy
PRUNE = """lists AS (SELECT p.record_id, any_value(length(d.seq)) AS n,
    list({'start': p.start, 'source': p.source, 'length': p.length} ORDER BY p.start) AS cur
  FROM pick p JOIN docs d USING (record_id) GROUP BY p.record_id),
prune AS (
  SELECT record_id, n, cur, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS edge, cur[1:0] AS kept,
    false AS done FROM lists
  UNION ALL
  SELECT record_id, n,
    CASE WHEN i > len(cur) AND len(kept) <> len(cur) THEN kept ELSE cur END,
    CASE WHEN i > len(cur) THEN 1 ELSE i + 1 END,
    CASE WHEN i > len(cur) THEN 0 WHEN dropped THEN edge ELSE stop END,
    CASE WHEN i > len(cur) AND len(kept) = len(cur) THEN kept
         WHEN i > len(cur) THEN kept[1:0] WHEN dropped THEN kept
         ELSE list_append(kept, cur[i]) END,
    i > len(cur) AND len(kept) = len(cur)
  FROM (SELECT *, cur[i].start + cur[i].length AS stop,
      len(cur) > 1 AND (
        (cur[i].start - edge > 0 AND cur[i].start - edge < 64) OR
        (coalesce(cur[i + 1].start, n) - (cur[i].start + cur[i].length) > 0 AND
         coalesce(cur[i + 1].start, n) - (cur[i].start + cur[i].length) < 64)) AS dropped
    FROM prune WHERE NOT done)),
pruned AS MATERIALIZED (SELECT record_id, k.start AS start, k.source AS source,
    k.length AS length
  FROM (SELECT record_id, unnest(kept) AS k FROM prune WHERE done))"""


def cost(blocks: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT d.record_id,
    (coalesce(sum(CASE b.type WHEN 'graph_copy' THEN 0 WHEN 'raw_residual' THEN 2 * b.length
       WHEN 'llm_residual' THEN greatest(1, 2 * b.length) END), 0) + 7) // 8
    + coalesce(sum(CASE b.type WHEN 'graph_copy' THEN 13 WHEN 'llm_residual' THEN 26
       WHEN 'raw_residual' THEN 17 END), 0) AS bytes,
    CASE WHEN count(*) FILTER (b.type <> 'graph_copy') > 8 THEN true
      WHEN count(*) FILTER (b.type <> 'graph_copy') = 0 THEN false
      ELSE count(*) FILTER (b.type <> 'graph_copy' AND b.length < 64)
           / (count(*) FILTER (b.type <> 'graph_copy'))::DOUBLE > 0.2
        AND sum(b.length) FILTER (b.type <> 'graph_copy') < any_value(length(d.seq)) END
      AS fragmented
  FROM docs d LEFT JOIN {blocks} b ON b.record_id = d.record_id GROUP BY d.record_id)"""


def grams(order: int, source: str, keys: str, name: str) -> str:
    """Context and symbol of every position of ``source(keys, seq)``."""
    return f"""{name} AS (SELECT {keys}, substr(seq, greatest(0, i - {order}) + 1,
    least({order}, i)) AS ctx, substr(seq, i + 1, 1) AS sym
  FROM (SELECT *, unnest(range(length(seq))) AS i FROM {source}))"""


def scored(order: int, fragments: str) -> str:
    """Bits of every fragment under the model of its record."""
    return f"""{grams(order, 'docs', 'record_id', 'doc_grams')},
cnt AS MATERIALIZED (SELECT record_id, ctx, sym, count(*) AS c FROM doc_grams GROUP BY ALL),
tot AS MATERIALIZED (SELECT record_id, ctx, sum(c) AS t FROM cnt GROUP BY ALL),
{grams(order, fragments, 'record_id, start', 'frag_grams')},
bits AS (SELECT f.record_id, f.start,
    fsum(-log2((coalesce(c.c, 0) + 1.0) / (coalesce(t.t, 0) + 5.0))) AS bits
  FROM frag_grams f LEFT JOIN cnt c USING (record_id, ctx, sym)
    LEFT JOIN tot t USING (record_id, ctx)
  GROUP BY f.record_id, f.start)"""


COMPOSITION = """CAST(length(seq) AS BIGINT) AS length,
  round(CASE WHEN length(seq) = 0 THEN 0 ELSE
    length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / length(seq) END, 9) AS gc_fraction,
  round(CASE WHEN length(seq) = 0 THEN 0 ELSE list_sum([CASE WHEN m = 0 THEN 0.0
    ELSE -(m::DOUBLE / length(seq)) * log2(m::DOUBLE / length(seq)) END
    FOR m IN [length(seq) - length(replace(seq, s, '')) FOR s IN ['A','C','G','T','N']]]) END, 6)
    AS shannon_bits_per_base"""

LZ76 = """walk AS (
  SELECT record_id, seq, CAST(0 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS size,
    CAST(1 AS BIGINT) AS phrases FROM docs WHERE length(seq) > 0
  UNION ALL
  SELECT record_id, seq, CASE WHEN found THEN idx ELSE idx + size END,
    CASE WHEN found THEN size + 1 ELSE 1 END, CASE WHEN found THEN phrases ELSE phrases + 1 END
  FROM (SELECT *, instr(substr(seq, 1, idx), substr(seq, idx + 1, size)) > 0 AS found
    FROM walk WHERE idx + size < length(seq))),
phrases AS (SELECT record_id, max(phrases) AS phrases FROM walk GROUP BY record_id)"""

RESTORED = """SELECT doc_id AS record_id, '>doc_id_' || doc_id AS header, sha256(seq) AS sha256,
  CAST(length(seq) AS BIGINT) AS length FROM (SELECT doc_id,
  regexp_replace(upper(text), '{drop}', '', 'g') AS seq FROM documents)"""

# two symbols per hexadecimal digit
PAIRS = "[" + ", ".join(f"'{a}{b}'" for a in "ACGT" for b in "ACGT") + "]"


def packed_hex(text: str) -> str:
    full = f"rpad({text}, CAST((length({text}) + 3) // 4 * 4 AS INT), 'A')"
    return f"""coalesce(list_aggregate([substr('0123456789ABCDEF',
      list_position({PAIRS}, substr({full}, CAST(2 * i + 1 AS INT), 2)), 1)
      FOR i IN range((length({text}) + 3) // 4 * 2)], 'string_agg', ''), '')"""


def u32(value: str) -> str:
    return f"lpad(printf('%X', CAST({value} AS BIGINT)), 8, '0')"


def weights_cdf() -> str:
    """Integer frequencies of each record's five symbol counts, marks strictly increasing."""
    shares = "w[1]"
    columns = []
    for i in range(1, 6):
        if i > 1:
            shares = f"({shares} + w[{i}])"
        mark = f"CAST(round_even(acc[{i}] * 32768, 0) AS BIGINT)"
        columns.append(mark)
    levels = "SELECT record_id, w, n, acc, greatest({0}, 1) AS c1 FROM accs".format(columns[0])
    for i in range(2, 6):
        levels = f"SELECT *, greatest({columns[i - 1]}, c{i - 1} + 1) AS c{i} FROM ({levels})"
    return f"""ws AS (SELECT record_id, length(seq) AS n,
    [CAST(length(seq) - length(replace(seq, s, '')) AS DOUBLE)
     FOR s IN ['A','C','G','T','N']] AS w FROM docs WHERE length(seq) > 0),
accs AS (SELECT *, [0 + w[1] / n, (0 + w[1] / n) + w[2] / n,
    ((0 + w[1] / n) + w[2] / n) + w[3] / n,
    (((0 + w[1] / n) + w[2] / n) + w[3] / n) + w[4] / n,
    ((((0 + w[1] / n) + w[2] / n) + w[3] / n) + w[4] / n) + w[5] / n] AS acc FROM ws),
cdfs AS ({levels})"""


def all_queries() -> dict[str, str]:
    out: dict[str, str] = {}
    out["fasta_text"] = f"""WITH {DOCS}, t AS (SELECT record_id, seq,
      '>doc_id_' || record_id || chr(10) || coalesce(list_aggregate(
        [substr(seq, CAST(80 * i + 1 AS INT), 80) FOR i IN range((length(seq) + 79) // 80)],
        'string_agg', chr(10)), '') || chr(10) AS text FROM docs)
    SELECT record_id, sha256(text) AS text_sha256, CAST(length(text) AS BIGINT) AS text_length,
      sha256(seq) AS seq_sha256 FROM t"""
    # symbols in front of byte x of a file: whole lines of 81 bytes, and what the last one has
    def symbols_before(x: str) -> str:
        y = f"greatest({x} - head, 0)"
        return f"least(n, ({y} // 81) * 80 + least({y} % 81, 80))"

    out["fasta_pieces"] = f"""WITH {DOCS}, f AS (SELECT record_id, seq, length(seq) AS n,
        '>doc_id_' || record_id AS header, length('>doc_id_' || record_id) + 1 AS head
        FROM docs WHERE seq <> ''),
      r AS (SELECT *, unnest(range(0, head + n + (n + 79) // 80, 1000)) AS a FROM f),
      p AS (SELECT *, {symbols_before("a")} AS first, {symbols_before("(a + 1000)")} AS last FROM r)
      SELECT record_id, header, CAST(n AS BIGINT) AS record_length, CAST(first AS BIGINT) AS offset,
        CAST(last - first AS BIGINT) AS length,
        sha256(substr(seq, CAST(first + 1 AS INT), CAST(last - first AS INT))) AS sha256
      FROM p WHERE last > first"""
    out["fasta_normalise"] = r"""SELECT doc_id AS record_id,
      upper(regexp_replace(replace(text, 'ß', 'SS'), '^\s+|\s*\n\s*|\s+$', '', 'g')) AS seq FROM documents"""
    out["alphabet_violations"] = """SELECT doc_id AS record_id, coalesce(list_aggregate(
      list_sort(list_distinct(string_split(translate(text, 'ACGTN', ''), ''))),
      'string_agg', ''), '') AS symbols FROM documents"""
    out["seq_checksum"] = f"""WITH {DOCS} SELECT record_id, CAST(length(seq) AS BIGINT) AS length,
      sha256(seq) AS sha256 FROM docs"""
    out["context_tails"] = f"""WITH {DOCS} SELECT record_id, start,
      substr(seq, greatest(0, start - 64) + 1, least(64, start)) AS context
      FROM (SELECT record_id, seq, unnest(range(0, length(seq) + 1, 100)) AS start FROM docs)"""
    out["kmer_counts"] = f"""WITH {DOCS}, {kmers(6)} SELECT record_id, kmer,
      count(*) AS occurrences, min(pos) AS first_pos FROM km GROUP BY record_id, kmer"""
    out["kmer_sql"] = f"""WITH {DOCS}, {kmers(4)} SELECT record_id, kmer,
      count(*) AS occurrences FROM km GROUP BY record_id, kmer"""

    def edges(k: int) -> str:
        return f"""{kmers(k + 1)}, edges AS (SELECT record_id, substr(kmer, 1, {k}) AS source,
          substr(kmer, 2, {k}) AS target, count(*) AS cnt FROM km GROUP BY ALL)"""

    out["debruijn_edges"] = f"WITH {DOCS}, {edges(15)} SELECT * FROM edges"
    out["fasta_piece_edges"] = out["debruijn_edges"]
    out["debruijn_adjacency"] = f"WITH {DOCS}, {edges(5)} SELECT * FROM edges"
    out["debruijn_degrees"] = f"""WITH {DOCS}, {edges(6)} SELECT record_id, source,
      count(*) AS out_degree, CAST(sum(cnt) AS BIGINT) AS weight FROM edges GROUP BY ALL"""
    top = """top AS (SELECT *, row_number() OVER (PARTITION BY record_id
      ORDER BY cnt DESC, source, target) AS edge_rank FROM edges WHERE cnt >= 2)"""
    out["edges_topk"] = f"WITH {DOCS}, {edges(6)}, {top} SELECT * FROM top WHERE edge_rank <= 50"
    out["mermaid_charts"] = f"""WITH {DOCS}, {edges(6)}, {top},
      shown AS (SELECT * FROM top WHERE edge_rank <= 20),
      ends AS (SELECT record_id, edge_rank, 0 AS slot, source AS node FROM shown
        UNION ALL SELECT record_id, edge_rank, 1, target FROM shown),
      firsts AS (SELECT record_id, node, min(edge_rank * 3 + slot) AS place FROM ends GROUP BY ALL),
      lines AS (SELECT record_id, place, '    ' || node || '["' || node || '"]' AS line FROM firsts
        UNION ALL SELECT record_id, edge_rank * 3 + 2,
          '    ' || source || ' -->|' || cnt || '| ' || target FROM shown),
      bodies AS (SELECT record_id, string_agg(line, chr(10) ORDER BY place) AS body
        FROM lines GROUP BY record_id)
      SELECT record_id, 'flowchart LR' || chr(10) ||
        coalesce(body, '    empty["No edges to display"]') AS chart
      FROM docs LEFT JOIN bodies USING (record_id)"""
    # an edge's place in its chart is its rank; a node's first line is the least of three per edge
    out["mermaid_all_lines"] = f"""WITH {DOCS}, {edges(4).replace("edges AS (", "edges AS MATERIALIZED (")},
      ranked AS MATERIALIZED (SELECT *, row_number() OVER (
        PARTITION BY record_id ORDER BY cnt DESC, source, target) AS place FROM edges),
      firsts AS (SELECT record_id, node, min(line_no) AS line_no FROM (
        SELECT record_id, source AS node, 3 * place AS line_no FROM ranked
        UNION ALL SELECT record_id, target, 3 * place + 1 FROM ranked) GROUP BY ALL)
      SELECT f.record_id, cnt, source, target, CAST(line_no % 3 AS BIGINT) AS slot,
        '    ' || node || '["' || node || '"]' AS line
      FROM firsts f JOIN ranked r ON f.record_id = r.record_id AND line_no // 3 = place
      UNION ALL SELECT record_id, cnt, source, target, 2,
        '    ' || source || ' -->|' || cnt || '| ' || target FROM ranked"""
    out["output_names"] = r"""WITH named AS (SELECT doc_id, regexp_replace(list_extract(
        string_split('in/' || source || '/doc.v' || (doc_id % 1000) || '.fa', '/'), -1),
        '[.][^.]*$', '') || '.ghdna' AS name FROM documents)
      SELECT doc_id, name, count(*) OVER (PARTITION BY name) AS inputs FROM named"""
    out["mermaid_node_ids"] = """SELECT p_partkey,
      CASE WHEN p_name = '' OR regexp_matches(p_name, '^[0-9]') THEN 'node_' ELSE '' END
        || regexp_replace(p_name, '[^0-9A-Za-z_]', '_', 'g') AS name_id,
      'node_' || p_size AS size_id FROM part"""

    out["seed_index"] = f"""WITH {DOCS}, {kmers(15)} SELECT record_id, kmer,
      min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS occurrences,
      count(*) * (count(*) - 1) // 2 AS pairs FROM km GROUP BY record_id, kmer
      HAVING count(*) > 1"""
    out["best_sources"] = f"WITH {DOCS}, {best(15, 40)} SELECT * FROM best"
    picked = "SELECT record_id, start, source, length FROM pick"
    out["graph_repeats"] = f"{repeats(DOCS)} {picked}"
    out["graph_repeats_by_joins"] = out["graph_repeats"]
    out["graph_repeats_pages"] = f"{repeats(PAGES, 12, 24)} {picked}"
    out["graph_repeats_overlap"] = f"{repeats(DOCS, 15, 15, True)} {picked}"

    fragments = """frag AS (SELECT g.record_id, g.start,
        substr(d.seq, CAST(g.start + 1 AS INT), CAST(g.length AS INT)) AS seq
      FROM gaps g JOIN docs d USING (record_id))"""
    v1 = f"""{repeats(DOCS)}, {spans('pick')}, {fragments}, {scored(3, 'frag')},
      rows AS (SELECT record_id, 'graph_copy' AS type, start, length, source,
          CAST(NULL AS VARCHAR) AS seq, CAST(NULL AS DOUBLE) AS lm_bits FROM pick
        UNION ALL SELECT f.record_id, 'lm_raw', f.start, length(f.seq), NULL, f.seq,
          round(b.bits, 6) FROM frag f JOIN bits b USING (record_id, start)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY start) - 1
        AS block_no FROM rows)"""
    out["v1_blocks"] = f"""{v1} SELECT record_id, block_no, type, start, length, source, seq,
      lm_bits FROM placed"""
    out["archive_scan_v1"] = f"""{repeats(DOCS)}, {spans('pick')}, {fragments},
      rows AS (SELECT record_id, 'graph_copy' AS type, start, length, source,
          CAST(NULL AS VARCHAR) AS seq FROM pick
        UNION ALL SELECT record_id, 'lm_raw', start, NULL, NULL, seq FROM frag)
      SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY start) - 1 AS block_no,
        type, start, length, source, seq FROM rows"""
    residual = "type = 'llm_residual'"
    out["v2_blocks_plain"] = f"""{repeats(DOCS)}, {PLAIN_BLOCKS}
      SELECT n.record_id, block_no, type, start, length, source,
        CASE WHEN {residual} THEN length END AS symbol_count,
        CASE WHEN {residual} THEN 8 * length END AS bit_length,
        payload_offset, payload_length, false AS use_context,
        CASE WHEN {residual} THEN hex(substr(d.seq, CAST(start + 1 AS INT), CAST(length AS INT)))
          ELSE '' END AS payload
      FROM numbered n JOIN docs d USING (record_id)"""
    out["archive_scan"] = f"""{repeats(DOCS)}, {PLAIN_BLOCKS}
      SELECT record_id, block_no, type, start, length, source,
        CASE WHEN {residual} THEN length END AS symbol_count,
        CASE WHEN {residual} THEN 8 * length END AS bit_length,
        CASE WHEN {residual} THEN payload_offset END AS payload_offset,
        CASE WHEN {residual} THEN payload_length END AS payload_length FROM numbered"""
    out["block_table_hex"] = f"""{repeats(DOCS)}, {PLAIN_BLOCKS}
      SELECT record_id, block_no, CASE WHEN {residual}
        THEN '0200' || {u32('start')} || {u32('length')} || {u32('length')} || {u32('8 * length')}
          || {u32('payload_offset')} || {u32('payload_length')}
        ELSE '01' || {u32('start')} || {u32('source')} || {u32('length')} END AS entry
      FROM numbered"""
    out["diagnostics_plain"] = f"""{repeats(DOCS)}, {PLAIN_BLOCKS},
      sums AS (SELECT d.record_id, CAST(any_value(length(d.seq)) AS BIGINT) AS length,
          CAST(coalesce(sum(n.length) FILTER (type = 'graph_copy'), 0) AS BIGINT) AS copied,
          CAST(coalesce(sum(n.length) FILTER ({residual}), 0) AS BIGINT) AS rest,
          count(*) FILTER ({residual}) AS llm, count(*) FILTER (type = 'graph_copy') AS copies
        FROM docs d LEFT JOIN numbered n USING (record_id) GROUP BY d.record_id)
      SELECT record_id, length, CAST(1 AS BIGINT) AS candidate_count,
        CAST(0 AS BIGINT) AS context_residual_blocks, copied AS graph_copy_bases,
        round(CASE WHEN length = 0 THEN 0 ELSE copied::DOUBLE / length END, 9)
          AS graph_copy_fraction,
        llm AS llm_residual_blocks, rest AS llm_residual_payload_bytes, rest AS payload_bytes,
        CAST(0 AS BIGINT) AS raw_residual_blocks, CAST(0 AS BIGINT) AS raw_residual_payload_bytes,
        rest AS residual_bases, 'original' AS selected_candidate,
        CAST(0 AS BIGINT) AS selected_estimated_bytes, copies AS selected_repeat_count FROM sums"""
    out["block_metrics"] = f"""{repeats(DOCS)}, {PLAIN_BLOCKS}
      SELECT d.record_id, count(*) FILTER (type = 'graph_copy') AS graph_copy_blocks,
        count(*) FILTER ({residual}) AS residual_blocks,
        round((13 * count(*) FILTER (type = 'graph_copy') + 26 * count(*) FILTER ({residual})
          + coalesce(sum(payload_length), 0)) * 8.0::DOUBLE / nullif(any_value(length(d.seq)), 0), 6)
          AS body_bits_per_base
      FROM docs d LEFT JOIN numbered n USING (record_id) GROUP BY d.record_id"""
    out["v2_raw_blocks"] = f"""{repeats(PACKED)}, {model_blocks('pick')},
      raws AS (SELECT b.record_id, b.start, b.length,
          substr(d.seq, CAST(b.start + 1 AS INT), CAST(b.length AS INT)) AS text
        FROM blk b JOIN docs d USING (record_id) WHERE type = 'raw_residual')
      SELECT record_id, start, length, {packed_hex('text')} AS payload FROM raws"""
    out["block_table_model"] = f"""{repeats(PACKED)}, {model_blocks('pick')}
      SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY start) - 1 AS block_no,
        type, start, length, source, use_context,
        CASE WHEN type = 'llm_residual' THEN length END AS symbol_count,
        CASE WHEN type = 'raw_residual' THEN (length + 3) // 4 END AS raw_bytes FROM blk"""
    out["chunk_plan"] = f"""{repeats(PACKED)}, {model_blocks('pick')}
      SELECT b.record_id, row_number() OVER (PARTITION BY b.record_id ORDER BY b.start) - 1
          AS block_no, type, start, length, source, use_context,
        CASE WHEN type <> 'graph_copy' THEN sha256(substr(d.seq, CAST(start + 1 AS INT),
          CAST(length AS INT))) END AS text_sha256,
        sha256(CASE WHEN use_context THEN substr(d.seq,
          CAST(greatest(0, start - {CONTEXT}) + 1 AS INT), CAST(least({CONTEXT}, start) AS INT))
          ELSE '' END) AS context_sha256
      FROM blk b JOIN docs d USING (record_id)"""
    out["prune_repeats"] = f"""{repeats(PACKED)}, {PRUNE}
      SELECT record_id, start, source, length FROM pruned"""
    out["plan_cost"] = f"""{repeats(PACKED)}, {model_blocks('pick')}, {cost('blk', 'c')}
      SELECT record_id, CAST(bytes AS BIGINT) AS estimated_bytes, fragmented FROM c"""
    choice = f"""none AS (SELECT * FROM pick WHERE false),
      plain AS (WITH {model_blocks('none', 'b0')}, {cost('b0', 'c0')} SELECT * FROM c0),
      hybrid AS (WITH {model_blocks('pruned', 'b1')}, {cost('b1', 'c1')} SELECT * FROM c1),
      found AS (SELECT record_id, count(*) AS copies FROM pick GROUP BY record_id),
      kept AS (SELECT record_id, count(*) AS copies FROM pruned GROUP BY record_id),
      judged AS (SELECT p.record_id, f.copies AS found, k.copies AS kept, p.bytes AS plain_bytes,
          h.bytes AS hybrid_bytes,
          f.copies IS NOT NULL AND k.copies IS NOT NULL AND NOT h.fragmented
            AND h.bytes < p.bytes AS hybrid
        FROM plain p JOIN hybrid h USING (record_id) LEFT JOIN found f USING (record_id)
          LEFT JOIN kept k USING (record_id)),
      choice AS MATERIALIZED (SELECT record_id,
        CAST(CASE WHEN found IS NULL OR kept IS NULL THEN 1 ELSE 2 END AS BIGINT)
          AS candidate_count,
        CASE WHEN found IS NULL THEN 'original' WHEN hybrid THEN 'pruned_graph'
          ELSE 'no_graph' END AS selected_candidate,
        CAST(CASE WHEN found IS NULL THEN 0 WHEN hybrid THEN hybrid_bytes ELSE plain_bytes END
          AS BIGINT) AS selected_estimated_bytes,
        CAST(CASE WHEN hybrid THEN kept ELSE 0 END AS BIGINT) AS selected_repeat_count
      FROM judged)"""
    out["candidate_choice"] = f"""{repeats(PACKED)}, {PRUNE}, {choice} SELECT * FROM choice"""
    taken = "(SELECT record_id FROM choice WHERE selected_candidate = 'pruned_graph')"
    out["bench_variants"] = f"""{repeats(PACKED)}, {PRUNE}, {choice},
      v AS (
        SELECT 'graph_only' AS name, * FROM (WITH {spans('pick')}
          SELECT record_id, 'graph_copy' AS type, length, false AS use_context FROM pick
          UNION ALL SELECT record_id, 'llm_residual', length, false FROM gaps)
        UNION ALL SELECT 'dnagpt2_residual_only', * FROM (WITH {model_blocks('none', 'v0')}
          SELECT record_id, type, length, use_context FROM v0)
        UNION ALL SELECT 'graph_plus_dnagpt2', * FROM (WITH {model_blocks('pick', 'v1')}
          SELECT record_id, type, length, use_context FROM v1)
        UNION ALL SELECT 'adaptive_dnagpt2_hybrid', * FROM (WITH {model_blocks('pruned', 'v2')}
          SELECT record_id, type, length, use_context FROM v2 WHERE record_id IN {taken})
        UNION ALL SELECT 'adaptive_dnagpt2_hybrid', * FROM (WITH {model_blocks('none', 'v3')}
          SELECT record_id, type, length, use_context FROM v3 WHERE record_id NOT IN {taken})),
      plans AS (
        SELECT 'graph_only' AS name, record_id, 1 AS candidate_count,
          'original' AS selected_candidate, 0 AS selected_estimated_bytes,
          coalesce(copies, 0) AS selected_repeat_count
        FROM docs LEFT JOIN found USING (record_id)
        UNION ALL SELECT 'dnagpt2_residual_only', record_id, 1, 'original', 0, 0 FROM docs
        UNION ALL SELECT 'graph_plus_dnagpt2', record_id, 1, 'force_graph', 0,
          coalesce(copies, 0) FROM docs LEFT JOIN found USING (record_id)
        UNION ALL SELECT 'adaptive_dnagpt2_hybrid', record_id, candidate_count,
          selected_candidate, selected_estimated_bytes, selected_repeat_count FROM choice)
      SELECT p.name, p.record_id, any_value(CAST(candidate_count AS BIGINT)) AS candidate_count,
        any_value(selected_candidate) AS selected_candidate,
        any_value(CAST(selected_estimated_bytes AS BIGINT)) AS selected_estimated_bytes,
        any_value(CAST(selected_repeat_count AS BIGINT)) AS selected_repeat_count,
        count(*) FILTER (type = 'graph_copy') AS graph_copy_blocks,
        count(*) FILTER (type <> 'graph_copy') AS residual_blocks,
        CAST(coalesce(sum(length) FILTER (type = 'graph_copy'), 0) AS BIGINT) AS graph_copy_bases,
        CAST(coalesce(sum(length) FILTER (type <> 'graph_copy'), 0) AS BIGINT) AS residual_bases,
        count(*) FILTER (type = 'llm_residual') AS llm_residual_blocks,
        count(*) FILTER (type = 'raw_residual') AS raw_residual_blocks,
        count(*) FILTER (use_context) AS context_residual_blocks,
        CAST(coalesce(sum((length + 3) // 4) FILTER (type = 'raw_residual'), 0) AS BIGINT)
          AS raw_residual_payload_bytes
      FROM plans p LEFT JOIN v USING (name, record_id) GROUP BY p.name, p.record_id"""

    out["bench_variant_totals"] = f"""SELECT name, count(*) AS records,
        CAST(sum(residual_bases) AS BIGINT) AS residual_bases,
        CAST(sum(graph_copy_bases) AS BIGINT) AS graph_copy_bases,
        CAST(sum(graph_copy_blocks) AS BIGINT) AS graph_copy_blocks,
        CAST(sum(llm_residual_blocks) AS BIGINT) AS llm_residual_blocks,
        CAST(sum(raw_residual_blocks) AS BIGINT) AS raw_residual_blocks,
        CAST(sum(raw_residual_payload_bytes) AS BIGINT) AS raw_residual_payload_bytes
      FROM ({out["bench_variants"]}) GROUP BY name"""

    out["markov_counts"] = f"""WITH {DOCS}, {grams(3, 'docs', 'record_id', 'g')}
      SELECT record_id, ctx, sym, count(*) AS n FROM g GROUP BY ALL"""
    out["markov_trained"] = f"""WITH {DOCS}, {grams(2, 'docs', 'record_id', 'g')}
      SELECT ctx, sym, count(*) AS n FROM g GROUP BY ALL"""
    out["markov_bits"] = f"""WITH {DOCS}, whole AS (SELECT record_id, 0 AS start, seq FROM docs),
      {scored(3, 'whole')} SELECT record_id, round(coalesce(bits, 0), 6) AS bits
      FROM docs LEFT JOIN bits USING (record_id)"""
    out["composition"] = f"WITH {DOCS} SELECT record_id, {COMPOSITION} FROM docs"
    out["lz76"] = f"""WITH RECURSIVE {DOCS}, {LZ76}
      SELECT record_id, coalesce(phrases, 0) AS lz76_complexity
      FROM docs LEFT JOIN phrases USING (record_id)"""
    out["lz76_by_joins"] = out["lz76"]
    out["sequence_complexity"] = f"""WITH RECURSIVE {DOCS}, {LZ76}
      SELECT record_id, {COMPOSITION}, coalesce(phrases, 0) AS lz76_complexity,
        round(8.0::DOUBLE / (length(seq) + 1), 9) AS bits_per_base
      FROM docs LEFT JOIN phrases USING (record_id)"""

    out["pack_2bit"] = f"""WITH {PACKED} SELECT record_id, {packed_hex('seq')} AS payload
      FROM docs"""
    out["roundtrip_2bit"] = f"WITH {PACKED} SELECT record_id, seq FROM docs"
    bits = "translate(seq, 'ACGTN', '10100')"
    out["roundtrip_bits"] = f"""WITH {DOCS}, b AS (SELECT record_id, {bits} AS bits FROM docs),
      p AS (SELECT record_id, bits,
        rpad(bits, CAST((length(bits) + 7) // 8 * 8 AS INT), '0') AS full_bits FROM b)
      SELECT record_id, bits, coalesce(list_aggregate([substr('0123456789ABCDEF', CAST(1
          + 8 * CAST(substr(full_bits, CAST(4 * i + 1 AS INT), 1) AS INT)
          + 4 * CAST(substr(full_bits, CAST(4 * i + 2 AS INT), 1) AS INT)
          + 2 * CAST(substr(full_bits, CAST(4 * i + 3 AS INT), 1) AS INT)
          + CAST(substr(full_bits, CAST(4 * i + 4 AS INT), 1) AS INT) AS INT), 1)
        FOR i IN range(length(full_bits) // 4)], 'string_agg', ''), '') AS payload FROM p"""
    out["integer_cdf"] = f"""WITH {DOCS}, {weights_cdf()}
      SELECT record_id, concat_ws(',', c1, c2, c3, c4, c5) AS cdf, true AS valid,
        w[1] > 0 AND w[2] > 0 AND w[3] > 0 AND w[4] > 0 AND w[5] > 0 AS raw_valid FROM cdfs
      UNION ALL SELECT record_id, NULL, NULL, NULL FROM docs WHERE seq = ''"""
    ideal = f"""WITH {DOCS}, {weights_cdf()}
      SELECT record_id, round(w[1] * log2(c5::DOUBLE / c1) + w[2] * log2(c5::DOUBLE / (c2 - c1))
        + w[3] * log2(c5::DOUBLE / (c3 - c2)) + w[4] * log2(c5::DOUBLE / (c4 - c3))
        + w[5] * log2(c5::DOUBLE / (c5 - c4)), 3) AS bits FROM cdfs
      UNION ALL SELECT record_id, 0.0 FROM docs WHERE seq = ''"""
    out["ideal_bits"] = ideal
    out["coder_bits"] = f"""SELECT record_id, bits AS ideal_bits, true AS near_ideal FROM ({ideal})"""
    out["roundtrip_plain"] = f"""WITH {DOCS} SELECT record_id, seq,
      CAST(8 * length(seq) AS BIGINT) AS bit_length, CAST(length(seq) AS BIGINT) AS symbol_count
      FROM docs"""
    for name, drop in (
        ("roundtrip_model", "[^ACGT]+"),
        ("roundtrip_model_forced", "[^ACGT]+"),
        ("roundtrip_v1", "[^ACGTN]+"),
        ("roundtrip_v2", "[^ACGTN]+"),
    ):
        out[name] = RESTORED.replace("{drop}", drop)
    both = RESTORED.replace("{drop}", "[^ACGTN]+")
    out["roundtrip_any"] = f"{both} UNION ALL {both}"
    out["roundtrip_tokens"] = out["roundtrip_model"]
    out["blocks_by_lateral"] = f"SELECT * EXCLUDE (block_no) FROM ({out['archive_scan']})"
    out["repeats_by_table_function"] = out["graph_repeats"]
    out["digest_by_table_function"] = f"""WITH {DOCS} SELECT record_id,
      CAST((length(seq) + 499) // 500 AS BIGINT) AS pieces, CAST(length(seq) AS BIGINT) AS length,
      sha256(seq) AS sha256 FROM docs WHERE seq <> ''"""
    out["composition_by_pieces"] = out["composition"]
    cut = "substr(seq, CAST(4096 * i + 1 AS INT), 4096)"
    out["pack_by_pieces"] = f"""WITH {PACKED}, p AS (SELECT record_id, seq,
        unnest(range((length(seq) + 4095) // 4096)) AS i FROM docs),
      t AS (SELECT record_id, i, {cut} AS seq, translate({cut}, 'ACGT', '1010') AS bits FROM p),
      u AS (SELECT *, rpad(bits, CAST((length(bits) + 7) // 8 * 8 AS INT), '0') AS full_bits FROM t)
      SELECT record_id, CAST(i * 1024 AS BIGINT) AS byte_offset, {packed_hex('seq')} AS payload,
        CAST(i * 512 AS BIGINT) AS bit_byte_offset, list_aggregate([substr('0123456789ABCDEF', CAST(1
          + 8 * CAST(substr(full_bits, CAST(4 * j + 1 AS INT), 1) AS INT)
          + 4 * CAST(substr(full_bits, CAST(4 * j + 2 AS INT), 1) AS INT)
          + 2 * CAST(substr(full_bits, CAST(4 * j + 3 AS INT), 1) AS INT)
          + CAST(substr(full_bits, CAST(4 * j + 4 AS INT), 1) AS INT) AS INT), 1)
        FOR j IN range(length(full_bits) // 4)], 'string_agg', '') AS purines FROM u"""
    out["archive_metadata"] = f"""WITH d AS ({out["diagnostics_plain"]}), r AS ({both})
      SELECT record_id, 'json' AS format, 'GHDNA_1' AS magic, length, sha256, CAST(15 AS BIGINT) AS k,
        CAST(3 AS BIGINT) AS lm_order, NULL AS residual_codec, NULL AS payload_bytes,
        NULL AS block_table_count, true AS has_parameters FROM r
      UNION ALL SELECT record_id, 'binary', 'GHDNA_2', r.length, sha256, 15, 3, 'plain_ascii_v1',
        payload_bytes, llm_residual_blocks + selected_repeat_count, true FROM r JOIN d USING (record_id)"""
    # chunks of 100 tokens of 4 symbols; a context of whole tokens stays the same in front of a chunk
    out["token_chunk_plan"] = f"""{repeats(PACKED)}, {spans('pick')},
      b AS (SELECT record_id, 'graph_copy' AS type, start, length, source, false AS use_context FROM pick
        UNION ALL SELECT record_id, CASE WHEN size < 64 THEN 'raw_residual' ELSE 'llm_residual' END,
          p, size, NULL, size >= 64 AND p > 0 AND least(100, p) % 4 = 0
        FROM (SELECT record_id, p, least(400, start + length - p) AS size
          FROM (SELECT record_id, start, length, unnest(range(start, start + length, 400)) AS p FROM gaps)))
      SELECT b.record_id, row_number() OVER (PARTITION BY b.record_id ORDER BY b.start) - 1 AS block_no,
        type, start, length, source, use_context, sha256(CASE WHEN use_context THEN substr(d.seq,
          CAST(greatest(0, start - 100) + 1 AS INT), CAST(least(100, start) AS INT)) ELSE '' END)
          AS context_sha256
      FROM b JOIN docs d USING (record_id)"""
    out["roundtrip_by_joins"] = out["roundtrip_any"]
    out["archive_files_scan"] = f"SELECT * FROM ({out['archive_scan']}) WHERE block_no >= 0"
    out["archive_files_payloads"] = f"""SELECT record_id, block_no, start, length, payload
      FROM ({out["v2_blocks_plain"]}) WHERE type = 'llm_residual' AND length >= 20 AND block_no > 0"""
    return out
