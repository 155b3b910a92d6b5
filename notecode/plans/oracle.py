"""The registered queries as SQL over the given tables, to check the Spark results against."""

import re

from notecode.functions.text import MISSING_TOKENS
from notecode.plans.queries import SEED


def _number(text: str) -> str:
    """First 32 bits of an md5 as a number."""
    return f"('0x' || left(md5({text}), 8))::bigint"


_MISSING = ", ".join(f"'{token}'" for token in MISSING_TOKENS)
_STEP = f"{_number(f"concat('{SEED}:code:', doc_no, ':', j)")} % (j + 1)"

# Views in the order they build on each other; a query names the ones it needs.
VIEWS = {
    "part_codes": """
        select p_partkey, p_name, p_type,
          concat(case when p_type = 'STANDARD' then 'Z' else substr(p_type, 1, 1) end,
                 lpad(cast(p_size as varchar), 2, '0'), replace(p_brand, 'Brand#', '')) as code
        from part""",
    "ref_codes": """
        select code, min(h) as mco_had from (
          select code, case when p_partkey % 10 < 6 then 0 when p_partkey % 10 < 9 then p_partkey % 10 - 5 end as h
          from part_codes
          union all select 'Z769', 0) u
        group by code""",
    "dp_codes": "select code from ref_codes where mco_had = 0",
    "das_codes": "select code from ref_codes where mco_had in (0, 1, 2)",
    "annotations": """
        select l_orderkey as note_id, code,
          l_linenumber * 1000000000000000 + l_partkey * 10 + case when l_returnflag = 'R' then 1 else 0 end as place,
          case when l_linenumber <= 2 then 'DP'
               when l_linenumber = 3 and l_returnflag = 'R' then 'DR'
               when l_linenumber = 7 and l_returnflag = 'R' then 'OTHER' else 'DAS' end as position
        from lineitem join part_codes on l_partkey = p_partkey""",
    "annotations_last": """
        select note_id, code, first_place, position from (
          select *, min(place) over (partition by note_id, code) as first_place,
            row_number() over (partition by note_id, code order by place desc) as rn from annotations) y
        where rn = 1""",
    "notes_parsed": """
        select note_id,
          arg_max(code, first_place) filter (where position = 'DP') as dp,
          arg_max(code, first_place) filter (where position = 'DR') as dr
        from annotations_last group by note_id""",
    "notes_ruled": """
        select note_id, coalesce(dr, dp) as dp, case when dr is not null then dp else 'Z769' end as mdp
        from notes_parsed""",
    "das_parsed": """
        select note_id, string_agg(code, '|' order by code) as das
        from annotations_last where position = 'DAS' group by note_id""",
    "das_valid": """
        select note_id, string_agg(code, '|' order by code) as das
        from annotations_last where position = 'DAS' and code in (select code from das_codes) group by note_id""",
    "notes_clean": """
        select note_id, dp, mdp, case when note_id % 5 = 0 then 'test' else 'train' end as split
        from notes_ruled
        where dp in (select code from dp_codes) and mdp in (select code from dp_codes) and dp <> ''""",
    "notes_das": """
        select a.note_id, n.split, a.code as das
        from annotations_last a join notes_clean n on a.note_id = n.note_id
        where a.position = 'DAS' and a.code in (select code from das_codes)""",
    "readable": "select note_id, dp, dr, note_id % 50 in (2, 3, 4) as broken from notes_parsed",
    "raw_texts": """
        select note_id, case note_id % 50 when 0 then concat('{''seen'': None, ', body, '}')
            when 1 then concat('{', body, ',}') when 2 then concat('{', body, '} end')
            when 3 then concat('{''seen'': null, ', body, '}') when 4 then null
            else concat('{', body, '}') end as annot_diagnostics_v2
        from (select note_id, string_agg(concat('''', code, ''': {''position'': ''', position, '''}'), ', ' order by place) as body
              from (select distinct * from (
                      select *, min(place) over w as first_place, max(place) over w as last_place
                      from annotations window w as (partition by note_id, code)) e
                    where place in (first_place, last_place)) i
              group by note_id) t""",
    "text_parsed": """
        select r.note_id, case when not broken then dp end as dp, case when not broken then dr end as dr,
          case when broken then '' else coalesce(d.das, '') end as das
        from readable r left join das_parsed d on r.note_id = d.note_id""",
    "raw_flags": """
        select note_id, dp, dr, note_id % 41 <> 0 and note_id % 37 <> 0 and note_id % 50 <> 4 as complete
        from text_parsed""",
    "notes_train": """
        select * from notes_clean where split = 'train'
          and dp not in ('C09', 'C03', 'T918', 'E10', 'C50', 'C05', 'C10', 'E11ni', 'C67', 'C04')""",
    "labels_train": """
        select 'dp' as head, dp as label from notes_train
        union all select 'mdp', mdp from notes_train
        union all select 'das', d.das from notes_das d join notes_train n on d.note_id = n.note_id""",
    "labels_all": """
        select 'dp' as head, dp as label, split from notes_clean
        union all select 'mdp', mdp, split from notes_clean
        union all select 'das', das, split from notes_das""",
    "labels_before": """
        select a.head, a.label from (
          select 'dp' as head, dp as label, note_id from notes_clean
          union all select 'mdp', mdp, note_id from notes_clean
          union all select 'das', das, note_id from notes_das) a
        where a.note_id % 4 = 1 or (a.note_id % 2 = 0 and a.note_id in (select note_id from notes_train))""",
    "synonyms": """
        select p_partkey as ordinal, code, concat(p_name, ' ', p_type, ' ', cast(p_partkey as varchar)) as libelle
        from part_codes""",
    "syn": "select ordinal, libelle as note_text, code as dp from synonyms where code in (select code from dp_codes)",
    "conversation_notes": """
        select conv_id * 1000 + turn as patient_id, d.document_no,
          case when d.document_no = 0 then text else 'copy' end as note_text, concat('P', cast(conv_id % 9 as varchar)) as dp
        from conversations, (values (0::bigint), (1)) d(document_no)
        where conv_id % 3 <> 0 and turn % 5 <> 4 and conv_id % 4 <> 0""",
    "label_sources": """
        select head, label, bool_or(source = 'train') as train, bool_or(source = 'syn') as syn,
          bool_or(source = 'test') as test, bool_or(source = 'other') as other
        from (select head, label, 'train' as source from labels_train
              union all select 'dp', dp, 'syn' from syn
              union all select head, label, 'test' from labels_all where split = 'test'
              union all select 'dp', dp, 'other' from conversation_notes) u
        group by head, label""",
    "label_space": """
        select head, label from label_sources
        where (head = 'dp' and (train or syn or test)) or (head <> 'dp' and (train or test))""",
    "train_ids": """
        select head, label, row_number() over (partition by head order by label) - 1 as label_id
        from (select distinct head, label from labels_train) u""",
    "numbered_ref": "select code, mco_had, row_number() over (order by code) - 1 as ordinal from ref_codes",
    "ref_space": """
        select head, label, row_number() over (partition by head order by ordinal) - 1 as label_id from (
          select 'dp' as head, code as label, ordinal from numbered_ref where mco_had = 0
          union all select 'das', code, ordinal from numbered_ref where mco_had in (0, 1, 2)
          union all select 'mdp', code, ordinal from numbered_ref where mco_had = 0 and code like 'Z%') u""",
    "usable": "select * from synonyms where code in (select code from das_codes)",
    "coded": """
        select code, count(*) as n_synonyms, row_number() over (order by code) - 1 as place
        from usable group by code""",
    "numbered": "select code, libelle, row_number() over (partition by code order by ordinal) - 1 as pick from usable",
    "drawn": f"""
        select doc_no, unnest(list_reduce(range(n - k, n), lambda acc, j:
            list_append(acc, case when list_contains(acc, {_STEP}) then j else {_STEP} end), []::bigint[])) as place
        from (select o_orderkey as doc_no, 1 + {_number(f"concat('{SEED}:k:', o_orderkey)")} % 8 as k,
                (select count(*) from coded) as n from orders) d""",
    "multi": f"""
        select doc_no, string_agg(libelle, chr(10) order by line, code) as note_text,
          string_agg(code, '|' order by line, code) as das
        from (select d.doc_no, c.code, s.libelle, {_number(f"concat('{SEED}:line:', d.doc_no, ':', c.code)")} as line
              from drawn d join coded c on d.place = c.place
              join numbered s on s.code = c.code
                and s.pick = {_number(f"concat('{SEED}:synonym:', d.doc_no, ':', c.code)")} % c.n_synonyms) x
        group by doc_no""",
    "scored": """
        select note_id, dp as dp_gold,
          case when note_id % 17 = 0 then null when note_id % 3 = 0 then dp
               when note_id % 3 = 1 then concat(substr(dp, 1, 3), '99') else mdp end as dp
        from notes_clean""",
    "head_scores": """
        select l_orderkey as note_id, 'das' as head, code as label, max(l_quantity) / 50 as score
        from lineitem join part_codes on l_partkey = p_partkey group by l_orderkey, code""",
    "docs": """
        select doc_id as note_id, text as note_text, lang, source,
          case when doc_id % 5 = 0 then 'test' else 'train' end as split from documents""",
    "typed": """
        select note_id, 'all' as doc_type from docs
        union all select note_id, 'EN' from docs where contains(note_text, ' the ')
        union all select note_id, 'FR' from docs where contains(note_text, ' que ')
        union all select note_id, 'DE' from docs where contains(note_text, ' und ')""",
    "leaks": """
        select note_id, left(note_text, 1000) in
            (select left(note_text, 1000) from docs where split = 'train') as leaked
        from docs where split = 'test'""",
    "shuffled": """
        select note_id, split as stream, note_text, row_number() over
            (partition by split order by md5(concat('42:0:', note_id)), note_id) - 1 as position from docs""",
    "counted": """
        select stream, position // 32 as batch, position, note_id,
          len(list_filter(regexp_split_to_array(note_text, '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')) as n_words from shuffled""",
    "placed": """
        select stream, batch, position, note_id, n_words, 0::bigint as sub_batch, n_words as used
        from counted where position % 32 = 0
        union all
        select c.stream, c.batch, c.position, c.note_id, c.n_words,
          case when p.used > 0 and p.used + c.n_words > 12000 then p.sub_batch + 1 else p.sub_batch end,
          case when p.used > 0 and p.used + c.n_words > 12000 then c.n_words else p.used + c.n_words end
        from placed p join counted c on c.stream = p.stream and c.batch = p.batch and c.position = p.position + 1""",
    "feed_notes": """
        select 'real' as stream, 32 as size, doc_id as note_id, text as note_text, 'documents.parquet' as fragment from documents
        union all select 'real', 32, -1 - page_id, html, 'pages.parquet' from pages
        union all select 'syn', 128, item_id, text, 'benchmark.parquet' from benchmark""",
    "feed_places": """
        select *, row_number() over (partition by stream
          order by md5(concat('42:0:', fragment)), fragment, md5(concat('42:0:', note_id)), note_id) - 1 as position
        from feed_notes""",
    "feed_counted": """
        select stream, fragment, note_id, position, position // size as batch, position % size as place,
          len(list_filter(regexp_split_to_array(coalesce(note_text, ''), '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')) as n_words
        from feed_places""",
    "feed_placed": """
        select *, 0::bigint as sub_batch, n_words as used from feed_counted where place = 0
        union all
        select c.*,
          case when p.used > 0 and p.used + c.n_words > 12000 then p.sub_batch + 1 else p.sub_batch end,
          case when p.used > 0 and p.used + c.n_words > 12000 then c.n_words else p.used + c.n_words end
        from feed_placed p join feed_counted c on c.stream = p.stream and c.batch = p.batch and c.place = p.place + 1""",
    "doc_words": """
        select note_id, lang, split, list_filter(regexp_split_to_array(note_text, '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '') as words
        from docs""",
    "windows": "select note_id, words, unnest(range(0, len(words), 256)) as start from doc_words",
    "weighted_words": """
        select lang as label, unnest(words) as token, case when note_id % 2 = 0 then 1.0 else 0.1 end::double as weight
        from doc_words where split = 'train'""",
    "nb_tokens": "select label, token, sum(weight) as n from weighted_words group by label, token",
    "nb_labels": """
        select lang as label, sum(w) as n_notes, sum(w * len(words)) as n_tokens
        from (select *, case when note_id % 2 = 0 then 1.0 else 0.1 end::double as w from doc_words where split = 'train') t
        group by lang""",
    "nb_bases": """
        select label, ln(n_notes / (select sum(n_notes) from nb_labels)) as prior,
          ln(1.0 / (n_tokens + (select count(distinct token) from nb_tokens))) as unseen from nb_labels""",
    "nb_scores": """
        select note_id, b.label, any_value(b.prior) + any_value(len(words)) * any_value(b.unseen) + coalesce(any_value(g.gain), 0) as score
        from (select * from doc_words where split = 'test') d cross join nb_bases b
        left join (select w.note_id, t.label, sum(ln(t.n + 1)) as gain
                   from (select note_id, unnest(words) as token from doc_words where split = 'test') w
                   join nb_tokens t on w.token = t.token group by w.note_id, t.label) g
          using (note_id, label)
        group by note_id, b.label""",
    "coded_documents": """
        select left(cast(conv_id * 100 + turn as varchar), greatest(length(cast(conv_id * 100 + turn as varchar)) - 2, 0)) as patient_id,
          turn as document_no, text as note_text,
          case when turn % 3 <> 0 then concat('C', cast(conv_id % 7 as varchar), ' x') end as dp_gold
        from conversations""",
    "grouped": """
        select patient_id, count(*) as n_documents, string_agg(note_text, ' ' order by document_no) as note_text
        from coded_documents group by patient_id""",
    "aligned": """
        select g.dp_gold, concat('C', cast(len(list_filter(regexp_split_to_array(t.note_text, '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')) % 7 as varchar)) as dp
        from grouped t join (select patient_id, split_part(arg_min(dp_gold, document_no) filter (where dp_gold is not null), ' ', 1) as dp_gold
                             from coded_documents group by patient_id) g using (patient_id)""",
    "head_pairs": """
        select note_id, head, label, max(g) as g, max(p) as p from (
          select note_id, 'dp' as head, dp_gold as label, 1 as g, 0 as p from scored where dp is not null
          union all select note_id, 'dp', dp, 0, 1 from scored where dp is not null
          union all select note_id, 'mdp', mdp, 1, 0 from notes_clean
          union all select note_id, 'mdp', 'Z769', 0, 1 from notes_clean
          union all select note_id, 'das', das, 1, 0 from notes_das
          union all select note_id, 'das', label, 0, 1 from head_scores
            where score >= 0.5 and note_id in (select note_id from notes_clean)) u
        group by note_id, head, label""",
}

# One row per label with its counts, from rows (slice, gold, predicted).
_COUNTS = """
    select {by}label, sum(tp) as tp, sum(g) as n_gold, sum(p) as n_pred from (
      select {by}dp_gold as label, cast(dp_gold = dp as bigint) as tp, 1 as g, 0 as p from {rows}
        where dp is not null and dp_gold is not null
      union all select {by}dp, 0, 0, 1 from {rows} where dp is not null and dp_gold is not null) u
    group by {by}label"""

_SCORES = """
    case when n_pred = 0 then 0 else tp / n_pred end as precision,
    case when n_gold = 0 then 0 else tp / n_gold end as recall,
    case when n_gold + n_pred = 0 then 0 else 2 * tp / (n_gold + n_pred) end as f1"""


def _report(counts: str, by: str = "") -> str:
    group = f"group by {by.rstrip(', ')}" if by else ""
    return f"""
        select {by}cast(sum(n_gold) as bigint) as n_gold,
          round(sum(tp) / sum(n_pred), 6) as micro_precision, round(sum(tp) / sum(n_gold), 6) as micro_recall,
          round(2 * sum(tp) / (sum(n_gold) + sum(n_pred)), 6) as micro_f1,
          round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall,
          round(avg(f1), 6) as macro_f1
        from (select *, {_SCORES} from ({counts}) c) s {group}"""


def _cut(column: str) -> str:
    return f"""case when granularity = 0 then {column} when granularity > 0 then left({column}, granularity)
               else left({column}, greatest(length({column}) + granularity, 0)) end"""


_CUT_SCORED = f"""(select granularity, {_cut('dp_gold')} as dp_gold, {_cut('dp')} as dp
                   from scored, (values (0::bigint), (3), (-1)) g(granularity))"""
_TYPED_SCORED = """(select t.doc_type, d.lang as dp_gold,
                      case when note_id % 3 = 0 then d.lang when note_id % 7 <> 0 then 'en' end as dp
                    from docs d join typed t using (note_id))"""
_SCORED_REPORT = _report(_COUNTS.format(by="", rows="scored"))

BODIES = {
    "notes_csv_scan": """
        select note_id, concat('Note ', note_id, chr(10), 'line "two", end') as clinical_note,
          annot_diagnostics_v2, case when note_id % 37 <> 0 then concat('w', note_id % 9) end as ward
        from raw_texts where note_id % 41 <> 0
        union all select note_id, null, annot_diagnostics_v2,
          case when note_id % 37 <> 0 then concat('w', note_id % 9) end from raw_texts where note_id % 41 = 0""",
    "split_csv_scan": f"""
        select doc_id, case when lang not in ({_MISSING}) then lang end as lang,
          case when text not in ({_MISSING}) then length(text) end as n_chars,
          case when text not in ({_MISSING}) then sha256(text) end as text_sha256 from documents""",
    "referential_scan": """
        select ordinal, code, concat('Label; ', code) as definition,
          case when ordinal % 11 <> 0 then cast(mco_had as double) end as mco_had
        from numbered_ref where ordinal % 17 <> 0""",
    "dataset_sink_roundtrip": """
        select n.note_id, concat('Note ', n.note_id) as note_text, dp, coalesce(das, '') as das, mdp
        from notes_clean n left join das_valid d on n.note_id = d.note_id""",
    "label_space_ref": "select head, label, label_id from ref_space",
    "drop_incomplete_rows": """
        select note_id, concat('Note ', note_id, chr(10), 'line "two", end') as clinical_note, annot_diagnostics_v2
        from raw_texts where note_id % 41 <> 0 and note_id % 37 <> 0 and annot_diagnostics_v2 is not null""",
    "filter_valid_codes": "select note_id, dp, mdp from notes_clean",
    "drop_denied_codes": """
        select note_id, dp, mdp from notes_ruled
        where dp is not null and dp not in (select code from ref_codes where mco_had > 0)
          and dp not in ('C09', 'C03', 'T918', 'E10', 'C50', 'C05', 'C10', 'E11ni', 'C67', 'C04')""",
    "doc_type_slices": "select note_id, doc_type from typed",
    "mdp_rule": "select note_id, dp, mdp from notes_ruled",
    "assign_note_ids": "select row_number() over (order by doc_id) - 1 as note_id, doc_id, lang from documents",
    "truncate_codes": f"""
        select code, granularity, {_cut('code')} as cut
        from ref_codes, (values (0::bigint), (3), (-1), (-2)) g(granularity)""",
    "parse_annotations": "select note_id, dp, dr, das from text_parsed",
    "parse_python_notations": "select note_id, dp, dr, das from text_parsed",
    "annotation_routes": """
        select case when note_id % 50 in (0, 1) then 'tokens' when note_id % 50 in (2, 3) then 'python'
            when note_id % 50 = 4 then 'missing' else 'json' end as route, count(*) as n
        from raw_texts group by 1""",
    "filter_das_codes": """
        select p.note_id, coalesce(das, '') as das
        from notes_parsed p left join das_valid d on p.note_id = d.note_id""",
    "clean_notes": """
        select c.note_id, concat('Note ', c.note_id, chr(10), 'line "two", end') as note_text, c.dp,
          coalesce(d.das, '') as das, c.mdp
        from notes_clean c join raw_flags f on f.note_id = c.note_id and f.complete and coalesce(f.dr, f.dp) is not null
        left join das_valid d on c.note_id = d.note_id""",
    "cleaning_funnel": """
        select step, stage, n from (
          select 0::bigint as step, 'read' as stage, count(*) as n from raw_flags
          union all select 1, 'complete', count(*) from raw_flags where complete
          union all select 2, 'with_dp', count(*) from raw_flags where complete and coalesce(dr, dp) is not null
          union all select 3, 'dp_valid', count(*) from raw_flags
            where complete and coalesce(dr, dp) in (select code from dp_codes)
          union all select 4, 'mdp_valid', count(*) from raw_flags
            where complete and coalesce(dr, dp) in (select code from dp_codes)
              and case when dr is not null then dp else 'Z769' end in (select code from dp_codes)) f""",
    "patient_explode": "select patient_id, document_no, note_text, dp from conversation_notes",
    "label_freq_single": "select head, label, count(*) as n from labels_train where head <> 'das' group by all",
    "label_freq_multi": "select head, label, count(*) as n from labels_train where head = 'das' group by all",
    "label_distinct": "select distinct head, label from labels_all",
    "top_labels": """
        select head, label, n, place from (
          select *, row_number() over (partition by head order by n desc, label) as place
          from (select head, label, count(*) as n from labels_all group by all) c) r where place <= 10""",
    "label_space_union": "select head, label from label_space",
    "label_coverage": """
        select head, label, kind from (
          select head, label, 'only_train' as kind from label_sources where train and not syn and not test
          union all select head, label, 'syn_not_train' from label_sources where syn and not train
          union all select head, label, 'eval_unseen' from label_sources where (test or other) and not train and not syn) k
        where head = 'dp'""",
    "label_ids": "select head, label, row_number() over (partition by head order by label) - 1 as label_id from label_space",
    "encode_labels": """
        select n.note_id, coalesce(e.label_id, -1) as dp_id, coalesce(d.ids, '') as das_id
        from notes_clean n left join train_ids e on e.head = 'dp' and e.label = n.dp
        left join (select note_id, string_agg(coalesce(cast(label_id as varchar), '?'), '|' order by das) as ids
                   from notes_das left join train_ids on head = 'das' and label = das group by note_id) d
          on d.note_id = n.note_id""",
    "decode_labels": """
        select n.note_id, e.label as dp, coalesce(d.das, '') as das
        from notes_clean n left join train_ids e on e.head = 'dp' and e.label = n.dp
        left join (select note_id, string_agg(label, '|' order by das) as das
                   from notes_das left join train_ids on head = 'das' and label = das group by note_id) d
          on d.note_id = n.note_id""",
    "label_oov": """
        select head, label, count(*) as n from labels_all
        where (head, label) not in (select (head, label) from ref_space) group by all""",
    "class_weights": """
        select head, label, n, round(sum(n) over (partition by head) / (count(*) over (partition by head) * n), 6) as weight
        from (select head, label, count(*) as n from labels_train group by all) f""",
    "label_statistics_kept": """
        select head, label, n, round(sum(n) over (partition by head) / (count(*) over (partition by head) * n), 6) as weight
        from (select head, label, count(*) as n from (
                select head, label from labels_train union all select 'dp', dp from syn) u group by all) f""",
    "label_statistics_changes": """
        select head, label, coalesce(b.n, 0) as n_before, coalesce(a.n, 0) as n_after
        from (select head, label, count(*) as n from labels_before group by all) b
        full join (select head, label, count(*) as n from labels_train group by all) a using (head, label)
        where coalesce(b.n, 0) <> coalesce(a.n, 0)""",
    "label_ids_extended": """
        select head, label, label_id from train_ids
        union all select 'dp', dp, row_number() over (order by dp) - 1
          + (select count(*) from train_ids where head = 'dp')
        from (select distinct dp from syn where dp not in (select label from train_ids where head = 'dp')) s""",
    "prefix_leakage": "select note_id, leaked from leaks",
    "prefix_leakage_summary": "select leaked, count(*) as n from leaks group by leaked",
    "synonym_scan": "select code, libelle from synonyms",
    "syn_dp": "select ordinal, note_text, dp from syn",
    "syn_das": "select doc_no, note_text, das from multi",
    "mix_streams": """
        select n.note_id, concat('Note ', n.note_id) as note_text, dp, mdp, 'real' as stream, 'real' as pipe,
          cast(1.0 as double) as sample_weight, coalesce(das, '') as das
        from notes_clean n left join das_valid d on n.note_id = d.note_id
        union all select ordinal, note_text, dp, null, 'syn', 'synthetic', cast(0.1 as double), null from syn
        union all select doc_no, note_text, null, null, 'syn_das', 'synthetic', cast(0.1 as double), das from multi""",
    "shuffle_dataset": "select note_id, stream, position from shuffled",
    "shuffle_fragment": """
        select note_id, split as stream, source as fragment, row_number() over (partition by split
          order by md5(concat('42:0:', source)), source, md5(concat('42:0:', note_id)), note_id) - 1 as position
        from docs""",
    "published_notes": "select note_id, dp, mdp, case when note_id % 5 = 0 then 'test' else 'train' end as split from notes_clean",
    "feed_from_files": "select stream, fragment, note_id, position, batch, n_words, sub_batch from feed_placed",
    "exact_note_ids": """
        select l_orderkey, l_linenumber, row_number() over (
          order by l_shipdate nulls first, l_orderkey nulls first, l_linenumber nulls first) + 99 as line_id from lineitem""",
    "mix_head_weights": """
        select note_id, 'real' as stream, cast(2.0 as double) as dp_weight, cast(0.5 as double) as das_weight,
          cast(1.0 as double) as mdp_weight from notes_clean
        union all select ordinal, 'syn', cast(0.2 as double), null, null from syn
        union all select doc_no, 'syn_das', null, cast(0.05 as double), null from multi""",
    "assign_batches_by_stream": """
        select stream, note_id, position // case when stream = 'train' then 32 else 128 end as batch from shuffled""",
    "assign_batches": "select stream, note_id, position // 32 as batch from shuffled",
    "score_notes": """
        select note_id, lang as dp_gold, case when contains(note_text, ' que ') then 'fr'
          when contains(note_text, ' und ') then 'de' else 'en' end as dp from docs""",
    "score_by_length": """
        select note_id, case when contains(note_text, ' que ') then 'fr' when contains(note_text, ' und ') then 'de'
          else 'en' end as dp, length(note_text) as n_chars from docs""",
    "select_single_label": """
        select note_id, head, label, round(score, 6) as score from (
          select *, row_number() over (partition by note_id, head order by score desc, label) as rn from head_scores) r
        where rn = 1""",
    "select_multi_label": """
        select note_id, head, coalesce(string_agg(label, '|' order by label) filter (where score >= 0.5), '') as labels
        from head_scores group by note_id, head""",
    "token_windows": """
        select note_id, start // 256 as window_no, len(words[start + 1 : start + 256]) as n_tokens,
          array_to_string(words[start + 1 : start + 256], ' ') as window_text from windows""",
    "pool_vectors": """
        select label, dim, round(sum(w * x) / sum(w), 6) as value from (
          select cast(label as bigint) as label, unnest(range(len(embedding))) as dim,
            cast(unnest(embedding) as double) as x,
            exp(vec_id % 7 - max(vec_id % 7) over (partition by label)) as w from embeddings) v
        group by label, dim""",
    "pool_vectors_mean": """
        select cast(label as bigint) as label, dim, round(avg(x), 6) as value from (
          select label, unnest(range(len(embedding))) as dim, cast(unnest(embedding) as double) as x from embeddings) v
        group by label, dim""",
    "pool_vectors_max": """
        select cast(label as bigint) as label, dim, round(max(x), 6) as value from (
          select label, unnest(range(len(embedding))) as dim, cast(unnest(embedding) as double) as x from embeddings) v
        group by label, dim""",
    "nb_fit": "select label, token, round(n, 6) as n from nb_tokens",
    "nb_predict": """
        select note_id, label, round(score, 6) as score from (
          select *, row_number() over (partition by note_id order by score desc, label) as rn from nb_scores) r
        where rn = 1""",
    "align_gold_pred": "select note_id, dp_gold, case when note_id % 11 <> 0 and (note_id % 5 <> 0 or note_id = 0) then dp end as dp from scored",
    "metrics_micro": f"select n_gold, micro_precision, micro_recall, micro_f1 from ({_SCORED_REPORT}) m",
    "metrics_macro": f"select macro_precision, macro_recall, macro_f1 from ({_SCORED_REPORT}) m",
    "metrics_per_label": f"""
        select label, cast(tp as bigint) as tp, cast(n_gold as bigint) as n_gold, cast(n_pred as bigint) as n_pred,
          round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1
        from (select *, {_SCORES} from ({_COUNTS.format(by="", rows="scored")}) c) s""",
    "metrics_by_granularity": _report(_COUNTS.format(by="granularity, ", rows=_CUT_SCORED), "granularity, "),
    "metrics_by_doc_type": _report(_COUNTS.format(by="doc_type, ", rows=_TYPED_SCORED), "doc_type, "),
    "metrics_by_head": _report(
        """select head, label, sum(case when g = 1 and p = 1 then 1 else 0 end) as tp, sum(g) as n_gold, sum(p) as n_pred
           from head_pairs group by head, label""",
        "head, ",
    ),
    "group_documents": "select patient_id, n_documents, note_text from grouped",
    "metrics_grouped": _report(_COUNTS.format(by="", rows="aligned")),
    "assign_sub_batches": "select stream, batch, note_id, n_words, sub_batch from placed",
}


def _with_views(body: str) -> str:
    """The query preceded by the views it needs, directly or through others."""
    needed, texts = [], body
    for name in reversed(VIEWS):
        if re.search(rf"\b{name}\b", texts):
            needed.insert(0, f"{name} as ({VIEWS[name]})")
            texts += VIEWS[name]
    return f"with recursive {', '.join(needed)} {body}" if needed else body


ORACLE = {name: _with_views(body) for name, body in BODIES.items()}
