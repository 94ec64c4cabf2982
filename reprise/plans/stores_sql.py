"""SQL of the queries of sources, sinks, streams and the ledger's rows; see :mod:`reprise.plans.oracle`."""

from __future__ import annotations

from reprise.plans.oracle import FIRST, names

CTES = {
    "live": f"""select doc_id as occ_id, {FIRST} + doc_id % 23 as inep, 'https://cdn.example.org/' || (doc_id % 69) || '.pdf'
        as pdf_url, 'RI' || (doc_id % 2) || ' (RI) / RE' || (doc_id % 5) || ' (RE)' as fornecedor, sha256(text) as sha256
        from documents""",
    "queue": """select o_orderkey as k, ['envio', 'pares', 'documento', 'evento', 'envio_completo', 'laudo', 'envio'][o_orderkey % 7 + 1]
        as tipo, 'aud_' || (o_orderkey // 50) as lote, o_orderkey % 13 = 0 as cortado, o_orderkey % 11 = 0 as sem_chave,
        o_orderkey % 400 * 100000 as bytes from orders""",
    "queue_reasons": """select *, case when cortado then 'carga ilegível' when tipo in ('envio', 'pares', 'documento', 'envio_completo')
        and sem_chave then 'sem chave' when tipo = 'documento' and bytes > 26214400 then 'recusado' end as motivo from queue""",
    "sent": "select * from queue_reasons where motivo is null",
    "replayed_lots": """select 'envio' as tipo, lote as chave, 'run_' || (k % 5) || '/' || case when k % 7 = 6 then 'recebido' else 'enviado' end
        as valor from sent where tipo in ('envio', 'envio_completo') qualify row_number() over (partition by lote order by k desc) = 1""",
    "replayed_lines": """select 'pares' as tipo, lote || '/' || (k // 20) || 'x' || n as chave, cast(k % 9 + n as varchar) as valor
        from sent, (values (1), (2)) t(n) where tipo in ('pares', 'envio_completo')
        qualify row_number() over (partition by lote, k // 20, n order by k desc) = 1""",
    "replayed_documents": """select 'documento' as tipo, 'doc_' || (k // 30) as chave, cast(bytes as varchar) as valor from sent
        where tipo = 'documento' qualify row_number() over (partition by k // 30 order by k desc) = 1""",
    "replayed_rest": """select tipo, case when tipo = 'evento' then lote when sem_chave then '' else 'doc_' || (k // 30) end as chave,
        case when tipo = 'evento' then '{"n":' || (k % 3) || '}' else cast(bytes as varchar) end as valor from sent where tipo in ('evento', 'laudo')""",
    "cp_sides": """select m.inep, m.pdf_url, m.sha256, o.inep as outro, arg_max(o.pagina || ':' || o.pdf_url, m.seq) as onde
        from (select distinct seq, inep, pdf_url, sha256 from members) m join reps o on o.seq = m.seq
        where o.inep <> 0 and o.inep is distinct from m.inep group by 1, 2, 3, 4""",
    "audited": """select o.*, exists (select 1 from members m where m.sha256 = o.sha256 and m.pdf_url = o.pdf_url
        and m.inep is not distinct from o.inep) as tem_duplicata from occ o""",
}

SELECTS = {
    "run_record": """select n as nome, v as valor from (values ('escolas_selecionadas', (select count(*) from register)),
        ('pdfs_selecionados', (select count(*) from tasks)), ('imagens_extraidas', (select count(*) from occ)),
        ('pdfs_com_imagem', (select count(distinct pdf_url) from occ)), ('imagens_unicas', (select count(distinct sha256) from occ)),
        ('grupos_duplicatas', (select count(*) from groups)), ('imagens_duplicadas', (select count(*) from audited where tem_duplicata)),
        ('escolas_afetadas', (select count(distinct inep) from members where inep <> 0)), ('pares', (select count(*) from chained)),
        ('pares_exatos', (select count(*) from chained where similaridade = 100)),
        ('pares_visuais', (select count(*) from chained where similaridade < 100)),
        ('fornecedores_afetados', (select count(distinct fornecedor) from groups where fornecedor <> '')),
        ('supabase_analisados', 0), ('supabase_pares', 0)) t(n, v)""",
    "thumbnails_reused": """select distinct sha256, case when bool_or(xref % 3 = 0) over (partition by sha256) then left(sha256, 16) || '_1_7.JPG'
        else first_value(left(sha256, 16) || '_' || pagina || '_' || xref || '.jpg') over (partition by sha256 order by pdf_url, pagina, xref)
        end as thumb_url, not bool_or(xref % 3 = 0) over (partition by sha256) as nova from exploded""",
    "stream_append": "select * from live",
    "stream_dedup": "select distinct pdf_url, sha256 from live",
    "stream_new_digests": "select sha256, min(pdf_url) as pdf_url from live group by 1",
    "stream_alerts": f"""select distinct l.occ_id, l.inep, l.sha256, o.inep as outro_inep from live l join (select sha256, inep,
        unnest({names('fornecedor')}) as nome from occ where inep <> 0) o on o.sha256 = l.sha256 and o.inep <> l.inep
        where list_contains({names('l.fornecedor')}, o.nome)""",
    "stream_marks": "select * from marks",
    "stream_replay": """select o_custkey, o_orderpriority, max(o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey)
        as o_orderstatus from orders group by 1, 2""",
    "replay_failures": "select k as item_id, tipo, motivo, 2::int as tentativas from queue_reasons where motivo is not null",
    "replay_stored": """select * from replayed_lots union all select * from replayed_lines union all select * from replayed_documents
        union all select * from replayed_rest""",
    "lot_headers": """select envio_id, 'fase5_todos' as run_id, '5' as fase, '2026-01-01 00:00:00' as criado_em, '' as autor, 'enviado' as status,
        count(*) as pares, cast((select count(distinct i) from (select inep_a as i, envio_id as e from lines union select inep_b, envio_id from lines)
        where e = l.envio_id) as bigint) as escolas, cast(sum(qtd_imagens) as bigint) as imagens, cast(sum(qtd_fotos_camera) as bigint) as fotos_camera,
        cast(to_json(list_sort(list_distinct(list_filter(list(uf_a) || list(uf_b), lambda u: u <> '')))) as varchar) as ufs
        from lines l group by envio_id""",
    "lot_events": """select 'envio_criado' as tipo, envio_id, null::varchar as par_id, null::varchar as doc_id, null::bigint as inep,
        '2026-01-01 00:00:00' as criado_em, cast(count(*) as varchar) as pares, null::varchar as arquivo_nome, null::varchar as falso_positivo,
        null::varchar as motivo_codigo from lines group by envio_id
        union all select 'documento_anexado', envio_id, null, doc_id, inep, strftime(criado_em, '%Y-%m-%d %H:%M:%S'), null, arquivo_nome, null, null
        from ledger_docs
        union all select 'marcacao_alterada', null, par_id, null, null, strftime(ts, '%Y-%m-%d %H:%M:%S'), null, null,
        case when coalesce(fp, false) then 'true' else 'false' end, nullif(mc[2:], '') from state_rows""",
    "audited_nested": """select occ_id, a.inep, a.sha256, tem_duplicata,
        coalesce((select string_agg(distinct grupo_id, ' ' order by grupo_id) from members m where m.sha256 = a.sha256 and m.pdf_url = a.pdf_url
        and m.inep is not distinct from a.inep), '') as grupos,
        coalesce((select string_agg(c.outro || ':' || c.onde, '|' order by c.outro) from cp_sides c where c.sha256 = a.sha256
        and c.pdf_url = a.pdf_url and c.inep is not distinct from a.inep), '') as duplicada_com from audited a""",
    "audited_first_page": """select occ_id, inep, tem_duplicata from audited order by tem_duplicata desc, coalesce(inep, 0), occ_id limit 200""",
    "register_rejected": "select uf, fase, count(*) as linhas from export where inep % 5 = 0 group by 1, 2",
    "cache_scan": """select pdf_url, count(*) as imagens, cast(sum(('0x' || left(sha256, 4))::bigint) as bigint) as soma from occ group by 1""",
    "register_csv_scan": "select inep, uf, fornecedor, fase, status_geral, cast(len(books) as bigint) as qtd_books from export",
    "memo_scan": "select sha256, lower(lpad(to_hex(phash), 16, '0')) as phash, 2 as width from hashes",
    "coordinate_scan": "select sha256, lat, lon from coords",
    "class_map_scan": "select sha256, classe from classes",
    "run_tables": """select r as run_id, case when r = 'r2' then 0 else (select count(*) from members) end as membros,
        case when r = 'r2' then 0 else (select count(distinct sha256) from members) end as imagens,
        case when r = 'r2' then 0 else (select count(*) from occ) end as linhas,
        case when r = 'r2' then 0 else (select count(*) from audited where tem_duplicata) end as duplicadas
        from (values ('r1'), ('r2'), ('r3')) t(r)""",
    "table_copies": "select escola_id_bubble, inep, uf, fornecedor, fase from register",
    "file_scan": "select occ_id % 8 as fatia, cast(count(*) * 65 as bigint) as bytes from occ group by 1",
    "digest_lookup": """select sha256(cast(l_partkey as varchar)) as sha256, count(*) as linhas from lineitem
        where l_partkey in (select p_partkey from part where p_size % 10 = 3) group by 1""",
}
