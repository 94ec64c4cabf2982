"""The catalogue restated as SQL over the input tables, written independently of the DataFrame code.

Each statement is a list of named sub-queries followed by the final select; only those it needs are included.
"""

from __future__ import annotations

import re

FIRST = 12000000
UF = "['AC','MA','BA','SP','RS']"
LABELS = (
    "case {c} when 'foto' then 'Foto de vistoria' when 'print_tela' then 'Print de tela' "
    "when 'documento' then 'Documento / planilha' when 'assinatura' then 'Assinatura' "
    "when 'em_branco' then 'Área em branco' when 'logo' then 'Logo / ícone' else 'Indefinido' end"
)


def names(x: str) -> str:
    return (
        f"list_filter(case when contains({x}, ' (RI)') or contains({x}, ' (RE)') then "
        f"list_transform(string_split({x}, '/'), lambda p: trim(replace(replace(trim(p), ' (RI)', ''), ' (RE)', ''))) "
        f"else [trim({x})] end, lambda n: n <> '')"
    )


def name_parts(x: str) -> str:
    stem = f"case when lower({x}) like '%.pdf' then left({x}, length({x}) - 4) else {x} end"
    return f"list_transform(string_split({stem}, ' - '), lambda s: trim(s))"


def name_fits(x: str) -> str:
    p = name_parts(x)
    return (f"coalesce(len({p}) >= 4 and regexp_full_match(({p})[1], '[0-9]+') "
            f"and regexp_full_match(({p})[2], '[A-Z][A-Z]'), false)")


def name_inep(x: str) -> str:
    return f"case when {name_fits(x)} then try_cast(({name_parts(x)})[1] as bigint) end"


def name_field(x: str, i: int) -> str:
    return f"case when {name_fits(x)} then ({name_parts(x)})[{i}] else '' end"


def name_school(x: str) -> str:
    p = name_parts(x)
    return (f"case when not {name_fits(x)} then '' when len({p}) > 4 "
            f"then array_to_string(({p})[4:len({p}) - 1], ' - ') else ({p})[4] end")


def haversine(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2 * 6371000.0 * asin(least(1.0, sqrt(power(sin((radians({c}) - radians({a})) / 2), 2) "
        f"+ cos(radians({a})) * cos(radians({c})) * power(sin((radians({d}) - radians({b})) / 2), 2)))))"
    )


def camera(w: str, h: str, test: str) -> str:
    r = f"(cast({w} as double) / nullif({h}, 0))"
    return f"coalesce({w} <> 0 and (abs({r} - 4.0/3) {test} 0.02 or abs({r} - 3.0/4) {test} 0.02), false)"


def classify(w, h, uni, flat, grad, white, sat, cores, stamp) -> str:
    r = f"(cast({w} as double) / nullif({h}, 0))"
    return (
        f"case when {uni} is null and {stamp} then 'foto' when {uni} is null then 'indefinido' "
        f"when greatest({w}, {h}) < 400 then 'logo' when {stamp} then 'foto' "
        f"when {uni} <= 0.005 and {flat} <= 0.72 then 'foto' when {grad} < 1.5 and {cores} <= 6 then 'em_branco' "
        f"when {white} >= 0.88 and {sat} < 12 then 'assinatura' "
        f"when {w} <> 0 and (abs({r} - 0.707) < 0.02 or abs({r} - 1.414) < 0.03) then 'documento' "
        f"when {sat} < 12 then 'documento' else 'print_tela' end"
    )


def micro(x: str) -> str:
    return (f"(case when {x} < 0 then '-' else '' end || cast(abs({x}) // 1000000 as varchar) || '.' "
            f"|| lpad(cast(abs({x}) % 1000000 as varchar), 6, '0'))")


def similarity(d: str) -> str:
    return f"round_even(greatest(0.0, (1 - {d} / 64.0) * 100), 1)"


def pair_of(x: str, y: str) -> str:
    """inep_a, inep_b, par_id of two numbers, as the views build them."""
    a, b = f"({FIRST} + {x} % 23)", f"({FIRST} + ({y}) % 23)"
    lo, hi = f"least({a}, {b})", f"(greatest({a}, {b}) + case when {a} = {b} then 1 else 0 end)"
    return f"{lo} as inep_a, {hi} as inep_b, {lo} || 'x' || {hi} as par_id"


SAME_FILE_ORDER = "pdf_filename, pagina, occ_id"
STAMP = "%Y-%m-%d %H:%M:%S"


def group_ctes(tag: str, source: str, keep: str = "c.credit is not null") -> dict[str, str]:
    """Groups, members and everything up to case images for occurrences with a ``cluster`` column."""
    t = tag
    return {
        f"shared{t}": f"""select cluster, count(distinct inep) as qi from {source} where coalesce(inep, 0) <> 0
            group by 1 having count(distinct inep) > 1""",
        f"owned{t}": f"""select distinct o.cluster, o.inep, unnest({names('o.fornecedor')}) as nome
            from {source} o join shared{t} using (cluster) where coalesce(o.inep, 0) <> 0""",
        f"credit{t}": f"""select cluster, string_agg(nome, ' / ' order by nome) as credit from (
            select cluster, nome from owned{t} join shared{t} using (cluster) group by cluster, nome, qi having count(*) = qi)
            group by 1""",
        f"grp{t}": f"""select cluster, coalesce(credit, '') as fornecedor, qi as qtd_ineps,
            qo as qtd_ocorrencias, qs as qtd_shas,
            case when qs = 1 then 'Exata (100%)' else 'Exata + Visual' end as tipo,
            row_number() over (order by qi desc, qo desc, cluster) as seq
            from (select cluster, count(*) as qo, count(distinct sha256) as qs from {source} group by 1)
            join shared{t} using (cluster) left join credit{t} c using (cluster) where {keep}""",
        f"groups{t}": f"select *, 'G' || lpad(cast(seq as varchar), 5, '0') as grupo_id from grp{t}",
        f"members{t}": f"""select o.*, g.grupo_id, g.seq, g.fornecedor as grupo_fornecedor
            from {source} o join groups{t} g using (cluster)""",
        f"reps{t}": f"""select * from members{t}
            qualify row_number() over (partition by seq, inep order by {SAME_FILE_ORDER}) = 1""",
        f"chain{t}": f"""select a.*, n.nx from reps{t} a join (select seq, occ_id, lead({{'inep': inep, 'uf': uf,
            'fornecedor': fornecedor, 'pdf_filename': pdf_filename, 'pagina': pagina, 'thumb_url': thumb_url,
            'sha256': sha256, 'phash': phash}}) over (partition by seq order by coalesce(inep, 0), {SAME_FILE_ORDER}) as nx
            from reps{t}) n using (seq, occ_id) where nx is not null""",
        f"chained{t}": f"""select grupo_id, inep as inep_a, uf as uf_a, fornecedor as fornecedor_a,
            pdf_filename as pdf_filename_a, pagina as pagina_a, thumb_url as thumb_url_a, nx.inep as inep_b, nx.uf as uf_b,
            nx.fornecedor as fornecedor_b, nx.pdf_filename as pdf_filename_b, nx.pagina as pagina_b,
            nx.thumb_url as thumb_url_b,
            case when sha256 = nx.sha256 then 'Exata (100%)' else 'Visual (Perceptual)' end as tipo_duplicata,
            {similarity("case when sha256 = nx.sha256 then 0 else bit_count(xor(phash, nx.phash)) end")} as similaridade,
            cast(case when sha256 = nx.sha256 then 0 else bit_count(xor(phash, nx.phash)) end as integer)
            as distancia_hamming, sha256 from chain{t}""",
        f"ci{t}": f"""select a.inep as inep_a, b.inep as inep_b, a.seq, a.grupo_id, a.grupo_fornecedor, a.sha256,
            a.sha256 = b.sha256 as exata, a.width as largura, a.height as altura,
            {camera('a.width', 'a.height', '<=')} as foto_camera, a.thumb_url as thumb_a, b.thumb_url as thumb_b,
            a.pagina as pagina_a, b.pagina as pagina_b, a.pdf_url as url_a, b.pdf_url as url_b, a.pdf_filename as name_a,
            b.pdf_filename as name_b, a.uf as uf_a, b.uf as uf_b, a.fornecedor as fornecedor_a, b.fornecedor as fornecedor_b,
            a.fase as fase_a, b.fase as fase_b, coalesce(k.classe, 'indefinido') as classe
            from reps{t} a join reps{t} b on a.seq = b.seq and a.inep < b.inep and a.inep <> 0
            left join memo k on k.sha256 = a.sha256""",
        f"cp{t}": f"""select inep_a, inep_b, lado, pdf_url, arg_min(pdf_filename, seq) as pdf_filename,
            arg_min(inep, seq) as inep, list_sort(list(distinct pagina)) as paginas from (
            select inep_a, inep_b, seq, 'a' as lado, url_a as pdf_url, name_a as pdf_filename, inep_a as inep,
              pagina_a as pagina from ci{t}
            union all select inep_a, inep_b, seq, 'b', url_b, name_b, inep_b, pagina_b from ci{t})
            group by 1, 2, 3, 4""",
        f"cpg{t}": f"""select c.*, {name_inep('c.pdf_filename')} as inep_no_nome,
            coalesce({name_inep('c.pdf_filename')} <> 0 and {name_inep('c.pdf_filename')} is distinct from c.inep, false)
            as inep_divergente, g.fora_do_raio, g.com_coordenada, g.distancia_max_m
            from cp{t} c left join geo g using (pdf_url)""",
        f"cf{t}": f"""select inep_a, inep_b, count(*) as qtd_imagens, count(*) filter (where exata) as qtd_exatas,
            count(*) filter (where foto_camera) as qtd_fotos_camera, count(*) filter (where classe = 'foto') as qtd_evidencias,
            count(*) filter (where classe = 'indefinido') as qtd_indefinidas, list_sort(list(distinct classe)) as classes,
            string_agg(distinct grupo_id, ' ' order by grupo_id) as grupos,
            list_sort(list_distinct(list_filter(list_transform(flatten(list(string_split(grupo_fornecedor, '/'))),
              lambda n: trim(n)), lambda n: n <> ''))) as fornecedores,
            arg_min({{'ua': uf_a, 'ub': uf_b, 'na': name_a, 'nb': name_b, 'fa': fornecedor_a, 'fb': fornecedor_b,
              'pa': fase_a, 'pb': fase_b}}, seq) as f from ci{t} group by 1, 2""",
        f"cd{t}": f"""select inep_a, inep_b, bool_or(inep_divergente) as pdf_divergente,
            cast(sum(coalesce(fora_do_raio, 0)) as bigint) as fora_do_raio,
            cast(sum(coalesce(com_coordenada, 0)) as bigint) as com_coordenada,
            coalesce(max(distancia_max_m), 0.0) as distancia_max_m,
            list_transform(list_sort(list({{'u': pdf_url, 'n': pdf_filename}}) filter (where lado = 'a')), lambda x: x.n)
              as nomes_pdf_a,
            list_transform(list_sort(list({{'u': pdf_url, 'n': pdf_filename}}) filter (where lado = 'b')), lambda x: x.n)
              as nomes_pdf_b,
            count(distinct pdf_url) < count(*) as mesmo_pdf from cpg{t} group by 1, 2""",
        f"base{t}": f"""select inep_a || 'x' || inep_b as par_id, inep_a, inep_b, f.ua as uf_a, f.ub as uf_b,
            {name_field('f.na', 3)} as municipio_a, {name_field('f.nb', 3)} as municipio_b,
            {name_school('f.na')} as escola_a, {name_school('f.nb')} as escola_b, f.fa as fornecedor_a,
            f.fb as fornecedor_b, f.pa as fase_a, f.pb as fase_b, fornecedores, qtd_imagens, qtd_exatas, qtd_fotos_camera,
            qtd_evidencias, qtd_indefinidas, classes, qtd_exatas = qtd_imagens as todas_exatas,
            qtd_evidencias = 0 and qtd_indefinidas = 0 as so_material_comum, pdf_divergente, mesmo_pdf, fora_do_raio,
            com_coordenada, distancia_max_m, nomes_pdf_a, nomes_pdf_b, grupos
            from cf{t} join cd{t} using (inep_a, inep_b)""",
        f"cases{t}": f"""select b.*, municipio_a <> '' and municipio_a = municipio_b as mesmo_municipio,
            uf_a = uf_b as mesma_uf, coalesce(k.falso_positivo, false) as falso_positivo,
            coalesce(k.mae_filho, false) as mae_filho, coalesce(k.motivo_codigo, '') as motivo_codigo,
            coalesce(k.motivo, '') as motivo, coalesce(k.marcado_em, '') as marcado_em,
            b.par_id in (select par_id from forwarded)
              or b.inep_a in (select inep_a from forwarded union select inep_b from forwarded)
              or b.inep_b in (select inep_a from forwarded union select inep_b from forwarded) as ja_encaminhado
            from base{t} b left join overlay k using (par_id)""",
    }


CTES: dict[str, str] = {
    # ---------------------------------------------------------------- occurrences and contents
    "occ0": f"""select doc_id as occ_id, {FIRST} + doc_id % 23 as s, sha256(text) as sha256 from documents""",
    "occ": f"""select occ_id, sha256, sha256 as cluster, case when occ_id % 17 <> 0 then s end as inep, {UF}[s % 5 + 1] as uf,
        case when s % 11 = 0 then 'Nao informado' when s % 4 = 0 then 'RI' || (s % 2)
          else 'RI' || (s % 2) || ' (RI) / RE' || (s % 5) || ' (RE)' end as fornecedor,
        case when s % 2 = 0 then '5' else '4.1' end as fase,
        (case when occ_id % 31 = 0 then s + 1 else s end) || ' - ' || {UF}[s % 5 + 1] || ' - MUN' || (s % 11) || ' - ESC '
          || s || ' - TIPO.pdf' as pdf_filename,
        'https://cdn.example.org/' || case when occ_id % 5 = 0 then 'shared' else cast(occ_id % 69 as varchar) end || '.pdf'
          as pdf_url,
        cast(occ_id % 12 + 1 as integer) as pagina, cast([1600, 1200, 2048, 1240][occ_id % 4 + 1] as integer) as width,
        cast([1200, 1600, 1153, 1754][occ_id % 4 + 1] as integer) as height,
        left(sha256, 16) || '_' || (occ_id % 12 + 1) || '_' || (occ_id % 7) || '.jpg' as thumb_url,
        cast(null as ubigint) as phash from occ0""",
    "contents": "select sha256, min(occ_id) as base_id from occ0 group by 1",
    "vectors": """select vec_id, cast(list_reduce(list_transform(embedding,
        lambda x: case when x >= list_sort(embedding)[33] then 1::uhugeint else 0::uhugeint end),
        lambda a, b: a * 2 + b) as ubigint) as bits from embeddings""",
    "hashes": """select sha256, base_id, xor(bits, cast(case base_id % 3 when 0 then 0::ubigint
        when 1 then cast(power(2::double, base_id % 62) as ubigint)
        else cast(power(2::double, base_id % 62) as ubigint) | cast(power(2::double, (base_id + 7) % 62) as ubigint) end
        as ubigint)) as phash
        from contents join vectors on vec_id = base_id % (select count(*) from embeddings)""",
    "hocc": "select o.* exclude (phash), h.phash from occ o join hashes h using (sha256)",
    # ---------------------------------------------------------------- coordinates and classes
    "places": """select sha256, base_id as b,
        -(20000000 + (base_id % 69) * 137911) - (base_id // 69) % 11 * 20
          - case when base_id % 10 = 7 then 3000 when base_id % 10 = 6 then 90000 else 0 end as la,
        -(44000000 + (base_id % 69) * 211313) + (base_id // 69) % 7 * 20 as lo from contents""",
    "stamps": f"""select sha256, b, case b % 10
        when 3 then replace({micro('la')}, '.', ',') || ' S 、 ' || replace({micro('lo')}, '.', ',') || ' W'
        when 4 then {micro('(-la)')} || '° S - ' || {micro('(-lo)')} || '° O'
        when 5 then {micro('(la + 20000000)')} || '° , ' || {micro('lo')} || '°'
        when 8 then 'protocolo ' || b
        when 9 then '51.500100 N, 10.120000 E | ' || {micro('la')} || '°, ' || {micro('lo')} || '°'
        else {micro('la')} || '°, ' || {micro('lo')} || '°' end as texto from places""",
    "found": r"""select sha256, texto, unnest(regexp_extract_all(texto, p, 1)) as la, unnest(regexp_extract_all(texto, p, 2))
        as ns, unnest(regexp_extract_all(texto, p, 3)) as lo, unnest(regexp_extract_all(texto, p, 4)) as we,
        generate_subscripts(regexp_extract_all(texto, p, 1), 1) as pos from (select *,
        '(?i)(-?\d{1,2}[.,]\d{3,})\s*°?\s*([SN])?[^\d+-]{1,4}(-?\d{1,3}[.,]\d{3,})\s*°?\s*([WOE])?' as p from stamps)""",
    "signed": """select sha256, pos, case when upper(ns) = 'S' then -abs(la1) else la1 end as la2,
        case when upper(we) in ('W', 'O') then -abs(lo1) else lo1 end as lo2
        from (select *, cast(replace(la, ',', '.') as double) as la1, cast(replace(lo, ',', '.') as double) as lo1 from found)""",
    "points": """select sha256, pos, case when la2 > 0 and la2 <= 34 then -la2 else la2 end as lat,
        case when lo2 > 0 and lo2 <= 74 then -lo2 else lo2 end as lon from signed""",
    "coords": """select c.sha256, p.lat, p.lon from contents c left join (select * from points
        where lat between -34 and 5.5 and lon between -74 and -34
        qualify row_number() over (partition by sha256 order by pos) = 1) p using (sha256)""",
    "measures": """select sha256, base_id as b, case when base_id % 13 <> 0 then 1 end as k from contents""",
    "measured": """select sha256, k * cast(case when b % 19 = 0 then 320 else [1600, 1200, 2048, 1240][b % 4 + 1] end as integer)
        as w, k * cast(case when b % 19 = 0 then 200 else [1200, 1600, 1153, 1754][b % 4 + 1] end as integer) as h,
        k * [0.0, 0.004, 0.016, 0.3, 0.0][b % 5 + 1]::double as uni, k * (case when b % 7 < 5 then 0.4 else 0.8 end) as flat,
        k * (case when b % 11 = 0 then 1.0 else 7.5 end) as grad, k * (case when b % 4 = 1 then 0.9 else 0.3 end) as white,
        k * (b % 6) * 4.0 as sat, k * (case when b % 3 = 0 then 4 else 120 end) as cores from measures""",
    "classes": f"""select m.sha256, {classify('w', 'h', 'uni', 'flat', 'grad', 'white', 'sat', 'cores', '(c.lat is not null)')}
        as classe from measured m join coords c using (sha256)""",
    "texture": f"""select sha256, {classify('w', 'h', 'uni', 'flat', 'grad', 'white', 'sat', 'cores', 'false')} as classe from measured""",
    "memo": "select * from classes where classe <> 'indefinido'",
    "photos": f"""select * from occ where {camera('width', 'height', '<')} and regexp_matches(pdf_filename, '^[0-9]{{8}}')""",
    "read": "select p.*, c.lat, c.lon from photos p join coords c using (sha256) where c.lat is not null",
    "centre1": """select pdf_url, median(cast(round(lat * 1000000) as bigint)) / 1000000 as cla,
        median(cast(round(lon * 1000000) as bigint)) / 1000000 as clo from read group by 1""",
    "moved": f"""select r.occ_id, x.n as axis, t.n as tens,
        case when x.n = 0 then -(abs(lat) + t.n) else lat end as la, case when x.n = 1 then -(abs(lon) + t.n) else lon end as lo,
        {haversine('cla', 'clo', 'lat', 'lon')} as here, cla, clo
        from read r join centre1 using (pdf_url), (values (0), (1)) x(n), (values (10), (20), (30), (40), (50), (60), (70)) t(n)""",
    "tried": f"""select *, {haversine('cla', 'clo', 'la', 'lo')} as d from moved
        where (axis = 0 and abs(la) <= 34) or (axis = 1 and abs(lo) <= 74)""",
    "best": """select * from tried where d < here
        qualify row_number() over (partition by occ_id order by d, axis, tens) = 1""",
    "fixed": """select r.*, case when b.d < 1000 then round_even(b.la, 6) else r.lat end as flat,
        case when b.d < 1000 then round_even(b.lo, 6) else r.lon end as flon, coalesce(b.d < 1000, false) as reparado
        from read r left join best b using (occ_id)""",
    "centre2": """select pdf_url, median(cast(round(flat * 1000000) as bigint)) as mla,
        median(cast(round(flon * 1000000) as bigint)) as mlo from fixed group by 1""",
    "located": f"""select *, case when d > 5000 then 'suspeita' when d > 50 then 'fora' else 'dentro' end as situacao,
        round_even(d, 1) as distancia_m from (
        select f.*, mla, mlo, {haversine('mla / 1000000', 'mlo / 1000000', 'flat', 'flon')} as d
        from fixed f join centre2 using (pdf_url))""",
    "geo": """select pdf_url, round_even(any_value(mla), 0) / 1000000 as centro_lat,
        round_even(any_value(mlo), 0) / 1000000 as centro_lon, 50.0::double as raio_m, any_value(t.n) as total,
        count(*) as com_coordenada, any_value(t.n) - count(*) as sem_coordenada,
        count(*) filter (where situacao = 'fora') as fora_do_raio, count(*) filter (where situacao = 'suspeita') as suspeitas,
        count(*) filter (where reparado) as reparadas,
        coalesce(max(distancia_m) filter (where situacao <> 'suspeita'), 0.0) as distancia_max_m,
        arg_min(pagina, {'p': pagina, 'o': occ_id}) as fachada_pagina,
        arg_min(distancia_m, {'p': pagina, 'o': occ_id}) as fachada_distancia_m
        from located join (select pdf_url, count(*) as n from photos group by 1) t using (pdf_url) group by 1""",
    # ---------------------------------------------------------------- triage
    "events1": f"""select *, {pair_of('user_id', 'user_id * 7 + 3')} from events""",
    "mark_events": """select 'fase5_todos' as run_id, par_id, ts, event_id as seq,
        case when event_type in ('click', 'signup', 'error') then true when event_type = 'purchase' then false end
          as falso_positivo,
        case when event_type = 'click' then ['mesma_escola', 'material_comum', 'equipamento_igual', 'erro_sistema',
          'conferido_ok', ''][event_id % 6 + 1] when event_type = 'error' then 'xx' end as motivo_codigo,
        case event_id % 3 when 0 then 'nota ' || event_id when 1 then '' end as motivo,
        case when event_type = 'view' then event_id % 2 = 0 end as mae_filho,
        case when event_id % 5 <> 0 then inep_a end as inep_a, case when event_id % 5 <> 0 then inep_b end as inep_b,
        case when event_id % 4 = 0 then '' else 'user' || (event_id % 5) end as autor from events1""",
    "good_events": """select * from mark_events where (falso_positivo is not null or mae_filho is not null)
        and (motivo_codigo is null or motivo_codigo in ('', 'mesma_escola', 'material_comum', 'equipamento_igual',
        'erro_sistema', 'conferido_ok', 'outro'))""",
    # Window form: last value that was set, the reasons reset by a cleared flag.
    "state_rows": """select *, row_number() over w as step,
        last_value(falso_positivo ignore nulls) over w as fp, last_value(mae_filho ignore nulls) over w as mf,
        last_value(inep_a ignore nulls) over w as ia, last_value(inep_b ignore nulls) over w as ib,
        last_value(nullif(autor, '') ignore nulls) over w as who,
        last_value(case when motivo_codigo is not null then 'v' || motivo_codigo when not falso_positivo then 'v' end
          ignore nulls) over w as mc,
        last_value(case when motivo is not null then 'v' || motivo when not falso_positivo then 'v' end ignore nulls) over w
          as mo, row_number() over (partition by run_id, par_id order by ts desc, seq desc) as back
        from good_events window w as (partition by run_id, par_id order by ts, seq
        rows between unbounded preceding and current row)""",
    "marks": """select run_id, par_id, coalesce(fp, false) as falso_positivo, nullif(mc[2:], '') as motivo_codigo,
        nullif(mo[2:], '') as motivo, coalesce(mf, false) as mae_filho, ia as inep_a, ib as inep_b, ts as atualizado_em,
        who as atualizado_por from state_rows where back = 1""",
    "legacy": f"""select par_id, bool_or(quality = 0) as falso_positivo, '2024-01-01 00:00:00' as marcado_em
        from (select quality, {pair_of('doc_id', 'doc_id * 5 + 1')} from labels) group by 1""",
    "overlay": """select par_id, case when m.par_id is not null then m.falso_positivo else l.falso_positivo end
        as falso_positivo, coalesce(m.mae_filho, false) as mae_filho, m.motivo_codigo, m.motivo,
        coalesce(l.marcado_em, strftime(m.atualizado_em, '%Y-%m-%d %H:%M:%S')) as marcado_em
        from marks m full join legacy l using (par_id)""",
    "forwarded": f"""select inep_a, inep_b, inep_a || 'x' || inep_b as par_id from (select
        {FIRST} + cast(n_nationkey as bigint) * 9 as inep_a, {FIRST} + cast(n_nationkey as bigint) * 9 + 4 as inep_b from nation)""",
    "requests": f"""select 'aud_' || strftime(o_orderdate, '%Y%m') as envio_id,
        case when o_orderkey % 19 = 0 then '' else par_id end as par_id, o_orderkey as posicao
        from (select *, {pair_of('o_custkey', '(o_orderkey // 5)')} from orders)""",
    "selection": "select envio_id, par_id, min(posicao) as posicao from requests where par_id <> '' group by 1, 2",
    "lines": "select s.envio_id, s.posicao, c.* from selection s join cases c using (par_id)",
    "uploads": """select 'aud_' || (doc_id % 12) as envio_id, 12000000 + doc_id % 23 as inep,
        'Laudo técnico nº ' || doc_id || ' – revisão.' || ['pdf', 'PDF', 'docx', 'exe', '', 'zip', 'jpeg'][doc_id % 7 + 1]
          as arquivo_nome, case when doc_id % 53 = 0 then 0 else n_chars * 1500 end as tamanho_bytes, sha256(text) as sha256,
        timestamp '2025-01-01' + to_minutes(doc_id % 500000) as criado_em,
        ['pdf', 'pdf', 'docx', 'exe', '', 'zip', 'jpeg'][doc_id % 7 + 1] as ext, doc_id from documents""",
    "admitted": """select *, case when tamanho_bytes = 0 then 'vazio' when tamanho_bytes > 26214400 then 'grande'
        when ext in ('exe', '') then 'extensao' end as motivo_recusa from uploads""",
    "ledger_docs": """select envio_id || '_' || inep || '_' || strftime(criado_em, '%Y%m%d_%H%M%S') as doc_id, envio_id, inep,
        arquivo_nome, envio_id || '/' || inep || '/' || strftime(criado_em, '%Y%m%d_%H%M%S') || '_Laudo_tecnico_n_' || doc_id
          || '_revisao.' || ['pdf', 'PDF', 'docx', 'exe', '', 'zip', 'jpeg'][doc_id % 7 + 1] as arquivo_path, sha256,
        tamanho_bytes, case ext when 'pdf' then 'application/pdf' when 'zip' then 'application/zip' when 'jpeg' then 'image/jpeg'
          else 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end as tipo_mime, criado_em
        from admitted where motivo_recusa is null""",
    "disk_runs": f"""select 'fase5_todos_' || o_custkey as run_id, 'disco' as fonte, case max(o_orderstatus)
        when 'F' then 'concluido' when 'O' then 'processando' else 'erro' end as status,
        strftime(min(o_orderdate), '{STAMP}') as iniciado_em from orders group by o_custkey""",
    "stored_runs": """select 'fase5_todos_' || (s_suppkey * 3) as run_id, 'banco' as fonte, 'concluido' as status,
        '2026-01-01 00:00:00' as iniciado_em from supplier""",
    "runs": """select run_id, fonte, case when status = 'processando' then 'interrompido' else status end as status, iniciado_em
        from (select *, 0 as r from disk_runs union all select *, 1 from stored_runs)
        qualify row_number() over (partition by run_id order by r) = 1""",
    # ---------------------------------------------------------------- register
    "register": f"""select c_custkey as k, 'key_' || c_custkey as escola_id_bubble, {FIRST} + c_custkey as inep,
        {UF}[c_custkey % 5 + 1] as uf,
        case when c_custkey % 29 = 0 then null when c_custkey % 3 = 0 then 'RI' || (c_custkey % 7) || ' (RI) / RE'
          || (c_custkey % 11) || ' (RE)' when c_custkey % 3 = 1 then 'RI' || (c_custkey % 7)
          else 'RE' || (c_custkey % 11) end as fornecedor,
        case when c_custkey % 29 = 0 then null else ['RI / RE', 'RI', 'RE'][c_custkey % 3 + 1] end as tipo_fornecedor,
        c_mktsegment as status_geral,
        case when c_custkey % 37 = 0 then 'Piloto' else cast(c_custkey % 5 + 1 as varchar) end as fase,
        list_transform(range(least(3, c_custkey % 4)), lambda i: 'https://cdn.example.org/' || c_custkey || '_' || i
          || '%20a+b.pdf?v=' || i) as books,
        timestamp '2024-01-01' + to_hours(c_custkey % 1000) as atualizacao,
        case when c_custkey % 6 <> 0 then timestamp '2024-01-01' + to_days(cast(c_custkey % 300 as integer)) end
          as ativacao_rede_externa, cast(null as timestamp) as ativacao_rede_interna from customer""",
    "export": """select case when k % 17 = 0 then inep + 50000000 else inep end as inep, uf,
        case when k % 29 = 0 then (case when k % 3 = 1 then null else null end)
          when k % 3 = 0 then ri || ' (RI) / ' || re || ' (RE)' when k % 3 = 1 then ri else re end as fornecedor,
        tipo_fornecedor, case when k % 23 = 0 then 'Conectada' else status_geral end as status_geral, fase,
        case when k % 8 = 0 then list_append(books, 'https://cdn.example.org/extra.pdf') else books end as books,
        case when k % 41 = 0 then null else atualizacao end as atualizacao, ativacao_rede_externa, ativacao_rede_interna, k
        from (select *, case when k % 7 = 0 then 'RIX' else 'RI' end || (k % 7) as ri, 'RE' || (k % 11) as re from register)""",
    "diff": """select case when c.inep is null then 'novo' when n.inep is null then 'orfao' when len(campos) > 0 then 'alterado'
        else 'igual' end as acao, case when c.inep is null or n.inep is null then [] else campos end as campos,
        coalesce(c.escola_id_bubble, 'inep_' || n.inep) as escola_id_bubble, coalesce(n.inep, c.inep) as inep,
        case when n.inep is null then c.uf else n.uf end as uf,
        case when n.inep is null then c.fornecedor else n.fornecedor end as fornecedor,
        case when n.inep is null then c.tipo_fornecedor else n.tipo_fornecedor end as tipo_fornecedor,
        case when n.inep is null then c.status_geral else n.status_geral end as status_geral,
        case when n.inep is null then c.fase else n.fase end as fase,
        case when n.inep is null then c.books else n.books end as books,
        case when n.inep is null then c.atualizacao else n.atualizacao end as atualizacao,
        case when n.inep is null then c.ativacao_rede_externa else n.ativacao_rede_externa end as ativacao_rede_externa,
        case when n.inep is null then c.ativacao_rede_interna else n.ativacao_rede_interna end as ativacao_rede_interna
        from (select n.inep as ni, c.inep as ci, list_filter([
          case when n.uf is distinct from c.uf then 'uf' end,
          case when n.fornecedor is distinct from c.fornecedor then 'fornecedor' end,
          case when n.tipo_fornecedor is distinct from c.tipo_fornecedor then 'tipo_fornecedor' end,
          case when n.status_geral is distinct from c.status_geral then 'status_geral' end,
          case when n.fase is distinct from c.fase then 'fase' end,
          case when n.books is distinct from c.books then 'books' end,
          case when n.atualizacao is distinct from c.atualizacao then 'atualizacao' end,
          case when n.ativacao_rede_externa is distinct from c.ativacao_rede_externa then 'ativacao_rede_externa' end],
          lambda x: x is not null) as campos from export n full join register c on n.inep = c.inep) d
        left join export n on n.inep = d.ni left join register c on c.inep = d.ci""",
    "merged": """select * exclude (acao, campos) from diff where acao in ('novo', 'alterado') union all by name
        select * exclude (k) from register r where escola_id_bubble not in
        (select escola_id_bubble from diff where acao in ('novo', 'alterado'))""",
    "tasks": """select inep, uf, coalesce(fornecedor, 'Nao informado') as fornecedor, fase, unnest(books) as pdf_url
        from register""",
    # ---------------------------------------------------------------- pairs by brute force
    "sreps": f"""select * from occ where inep <> 0
        qualify row_number() over (partition by sha256, inep order by {SAME_FILE_ORDER}) = 1""",
    "exact": """select a.sha256, a.inep as inep_a, a.uf as uf_a, a.fornecedor as fornecedor_a, a.pdf_filename as pdf_filename_a,
        a.pagina as pagina_a, a.thumb_url as thumb_url_a, b.inep as inep_b, b.uf as uf_b, b.fornecedor as fornecedor_b,
        b.pdf_filename as pdf_filename_b, b.pagina as pagina_b, b.thumb_url as thumb_url_b, 'Exata (100%)' as tipo_duplicata,
        100.0::double as similaridade, 0 as distancia_hamming
        from sreps a join sreps b on a.sha256 = b.sha256 and a.inep < b.inep""",
    "filepairs": """select a.sha256, a.occ_id as occ_id_a, a.pdf_filename as pdf_filename_a, a.pagina as pagina_a,
        b.occ_id as occ_id_b, b.pdf_filename as pdf_filename_b, b.pagina as pagina_b from occ a join occ b
        on a.sha256 = b.sha256 and a.occ_id < b.occ_id and (a.pdf_filename <> b.pdf_filename or a.pagina <> b.pagina)""",
    "near": """select a.sha256 as sha256_a, b.sha256 as sha256_b, cast(bit_count(xor(a.phash, b.phash)) as integer) as distancia,
        a.phash as pa, b.phash as pb from hashes a join hashes b on a.sha256 < b.sha256
        where bit_count(xor(a.phash, b.phash)) <= 8""",
    "visual0": """select d.distancia, a, b from near d join hocc a on a.sha256 = d.sha256_a join hocc b on b.sha256 = d.sha256_b""",
    "visual": """select distancia, case when a.occ_id < b.occ_id then a else b end as a,
        case when a.occ_id < b.occ_id then b else a end as b from visual0""",
    "schoolsides": """select inep_a as inep, uf_a as uf, fornecedor_a as fornecedor, pdf_filename_a as pdf, inep_b as other,
        fornecedor_b as fother, 'e' as kind, sha256 || inep_a || inep_b as pair from exact
        union all select inep_b, uf_b, fornecedor_b, pdf_filename_b, inep_a, fornecedor_a, 'e', sha256 || inep_a || inep_b from exact
        union all select a.inep, a.uf, a.fornecedor, a.pdf_filename, b.inep, b.fornecedor, 'v', a.occ_id || 'x' || b.occ_id
          from visual where a.inep <> b.inep
        union all select b.inep, b.uf, b.fornecedor, b.pdf_filename, a.inep, a.fornecedor, 'v', a.occ_id || 'x' || b.occ_id
          from visual where a.inep <> b.inep""",
    "filesides": """select pdf_filename_a as f, pagina_a as p, 'e' as kind from filepairs
        union all select pdf_filename_b, pagina_b, 'e' from filepairs
        union all select a.pdf_filename, a.pagina, 'v' from visual where a.pdf_filename <> b.pdf_filename
        union all select b.pdf_filename, b.pagina, 'v' from visual where a.pdf_filename <> b.pdf_filename""",
    # ---------------------------------------------------------------- clusters by recursion
    "arcs": """select sha256_a as x, sha256_b as y from near where distancia <= 2
        union all select sha256_b, sha256_a from near where distancia <= 2""",
    "reach": """select distinct x as node, x as r from arcs union select a.y, r.r from reach r join arcs a on a.x = r.node""",
    "parcs": """select x, y from arcs where x in (select sha256 from texture where classe = 'foto')
        and y in (select sha256 from texture where classe = 'foto')""",
    "preach": "select distinct x as node, x as r from parcs union select a.y, r.r from preach r join parcs a on a.x = r.node",
    "pcomp": "select node, min(r) as comp from preach group by 1",
    "bags": """select comp, list({'s': node, 'h': phash} order by node) as rest from pcomp join hashes on sha256 = node group by 1""",
    "seeded": """select comp, rest, rest[list_position(degs, list_max(degs))] as seed from (select comp, rest,
        list_transform(rest, lambda x: len(list_filter(rest, lambda y: bit_count(xor(x.h, y.h)) <= 2))) as degs from bags)""",
    "linkage": """select comp, rest, cast([] as struct(s varchar, h ubigint)[]) as grp from bags
        union all select comp, list_filter(rest, lambda x: not list_contains(list_transform(grp, lambda g: g.s), x.s)), grp from (
        select comp, rest, list_reduce(list_transform(rest, lambda c: [c]), lambda acc, c: case when c[1].s <> seed.s and
          len(list_filter(acc, lambda g: bit_count(xor(g.h, c[1].h)) > 2)) = 0 then list_concat(acc, c) else acc end, [seed]) as grp
        from (select comp, rest, rest[list_position(degs, list_max(degs))] as seed from (select comp, rest,
          list_transform(rest, lambda x: len(list_filter(rest, lambda y: bit_count(xor(x.h, y.h)) <= 2))) as degs
          from linkage where len(rest) > 0)))""",
    "linked": """select unnest(list_transform(grp, lambda g: g.s)) as sha256,
        list_min(list_transform(grp, lambda g: g.s)) as cluster from linkage where len(grp) > 0""",
    "mixed": "select c.sha256, coalesce(l.cluster, c.sha256) as cluster from contents c left join linked l using (sha256)",
    "mocc": "select o.* exclude (cluster), m.cluster from hocc o join mixed m using (sha256)",
    # ---------------------------------------------------------------- extraction stand-in
    "exploded": """select 'https://cdn.example.org/' || (doc_id % 69) || '.pdf' as pdf_url, cast(doc_id as integer) as xref,
        cast(unnest([doc_id % 12 + 1, doc_id % 5 + 20, doc_id % 3 + 40]) as integer) as pagina, case when doc_id % 10 = 0 then 80
        else 640 end as w, case when doc_id % 15 = 0 then 100 else 480 end as h, doc_id % 14 = 0 as uniforme,
        sha256(text) as sha256 from documents""",
    "pixels": """select vec_id, r, c, least(255, greatest(0, floor(128 + 2000 * embedding[r + 1]::double
        * embedding[33 + c]::double)))::integer as p from embeddings, range(32) a(r), range(32) b(c)""",
    **group_ctes("", "occ"),
    **group_ctes("_any", "occ", "true"),
    **group_ctes("_mix", "mocc"),
}
# Measures use only the pixel table; horizontal and vertical neighbours are self-joins.
CTES["dx"] = "select a.vec_id, a.r, a.c, abs(b.p - a.p) as d from pixels a join pixels b on a.vec_id = b.vec_id and a.r = b.r and b.c = a.c + 1"
CTES["dy"] = "select a.vec_id, a.r, a.c, abs(b.p - a.p) as d from pixels a join pixels b on a.vec_id = b.vec_id and b.r = a.r + 1 and a.c = b.c"

GROUP_COLUMNS = "grupo_id, cluster, fornecedor, qtd_ineps, qtd_ocorrencias, qtd_shas, tipo"
CASE_COLUMNS = (
    "par_id, inep_a, inep_b, uf_a, municipio_a, escola_a, fornecedor_a, fase_a, uf_b, municipio_b, escola_b, fornecedor_b, "
    "fase_b, qtd_imagens, qtd_exatas, qtd_fotos_camera, qtd_evidencias, qtd_indefinidas, todas_exatas, so_material_comum, "
    "pdf_divergente, mesmo_pdf, fora_do_raio, com_coordenada, distancia_max_m, mesmo_municipio, mesma_uf, falso_positivo, "
    "mae_filho, motivo_codigo, motivo, marcado_em, ja_encaminhado, array_to_string(fornecedores, '|') as fornecedores, "
    "array_to_string(classes, ',') as classes, array_to_string(nomes_pdf_a, '|') as nomes_pdf_a, "
    "array_to_string(nomes_pdf_b, '|') as nomes_pdf_b"
)
REGISTER_FLAT = (
    "array_to_string(books, ',') as books, strftime(atualizacao, '" + STAMP + "') as atualizacao, "
    "strftime(ativacao_rede_externa, '" + STAMP + "') as ativacao_rede_externa, "
    "strftime(ativacao_rede_interna, '" + STAMP + "') as ativacao_rede_interna"
)
FIELDS = "inep, uf, fornecedor, tipo_fornecedor, status_geral, fase"
SEARCH = ("lower(concat_ws(' ', inep_a, inep_b, escola_a, municipio_a, uf_a, fornecedor_a, escola_b, municipio_b, uf_b, "
          "fornecedor_b, array_to_string(nomes_pdf_a, ' '), array_to_string(nomes_pdf_b, ' ')))")
FILES = "lower(concat_ws(' ', array_to_string(nomes_pdf_a, ' '), array_to_string(nomes_pdf_b, ' ')))"
FILTER_SQL = {
    "busca": f"contains({SEARCH}, 'mun3')", "contem": f"contains({FILES}, 'mun1')",
    "nao_contem": f"not contains({FILES}, 'mun1')", "uf": "'BA' in (uf_a, uf_b)",
    "municipio": "'mun4' in (lower(municipio_a), lower(municipio_b))",
    "fornecedor": "len(list_filter(fornecedores, lambda n: contains(lower(n), 'ri1'))) > 0", "tipo_exatas": "todas_exatas",
    "falso_positivo": "not falso_positivo", "falso_positivo_somente": "falso_positivo", "encaminhado": "not ja_encaminhado",
    "mae_filho": "mae_filho", "min_imagens": "qtd_imagens >= 2", "somente_fotos": "qtd_fotos_camera > 0",
    "mesmo_municipio": "not mesmo_municipio", "com_foto": "qtd_evidencias > 0 or qtd_indefinidas > 0",
    "sem_foto": "so_material_comum", "fora_do_raio": "fora_do_raio > 0", "mesmo_pdf": "mesmo_pdf",
    "pdf_divergente": "pdf_divergente", "encaminhado_somente": "ja_encaminhado", "mae_filho_ocultar": "not mae_filho",
    "mesmo_municipio_sim": "mesmo_municipio",
}
SUMMARY = """select count(*) as pares, (select count(distinct i) from (select inep_a as i from {t} where {w} union all
    select inep_b from {t} where {w})) as escolas,
    cast(coalesce(sum(qtd_imagens), 0) as bigint) as imagens, cast(coalesce(sum(qtd_fotos_camera), 0) as bigint) as fotos_camera,
    cast(coalesce(sum(qtd_exatas), 0) as bigint) as exatas, cast(coalesce(sum(qtd_evidencias), 0) as bigint) as evidencias,
    count(*) filter (where so_material_comum) as so_material_comum, count(*) filter (where falso_positivo) as falsos_positivos,
    count(*) filter (where mae_filho) as mae_filho, count(*) filter (where ja_encaminhado) as ja_encaminhados,
    count(*) filter (where not falso_positivo) as pendentes, count(*) filter (where mesmo_municipio) as mesmo_municipio,
    count(*) filter (where mesmo_pdf) as mesmo_pdf, count(*) filter (where pdf_divergente) as pdf_divergente,
    count(*) filter (where fora_do_raio > 0) as fora_do_raio from {t} where {w}"""
YES = "case when {c} then 'sim' else 'nao' end"

SELECTS: dict[str, str] = {
    "exact_groups": f"select {GROUP_COLUMNS} from groups",
    "exact_groups_any_supplier": f"select {GROUP_COLUMNS} from groups_any",
    "template_clusters": """select cluster as sha256, qi as qtd_ineps, (select count(*) from occ o where o.sha256 = s.cluster)
        as qtd_ocorrencias from shared s where cluster not in (select cluster from credit)""",
    "group_members": "select grupo_id, grupo_fornecedor, occ_id, inep, pdf_filename, pagina, sha256 from members",
    "group_lists": """select grupo_id, string_agg(distinct cast(inep as varchar), ',' order by cast(inep as varchar)) filter
        (where inep <> 0) as ineps, string_agg(distinct fornecedor, '|' order by fornecedor) as fornecedores,
        string_agg(distinct uf, ',' order by uf) as ufs from members group by 1""",
    "group_search": """select grupo_id, qtd_ineps from groups join (select grupo_id, lower(concat_ws(' ',
        string_agg(distinct cast(inep as varchar), ' ') filter (where inep <> 0), string_agg(distinct fornecedor, ' '
        order by fornecedor), string_agg(distinct uf, ' ' order by uf))) as t from members group by 1) using (grupo_id)
        where qtd_ineps >= 2 and contains(t, 'ma')""",
    "group_page": "select grupo_id, qtd_ineps from groups order by seq limit 40",
    "evidence_images": "select sha256, min(thumb_url) as thumb_url from members group by 1",
    "run_metrics": """select (select count(*) from register) as escolas_selecionadas, (select count(*) from tasks)
        as pdfs_selecionados, (select count(*) from occ) as imagens_extraidas, (select count(distinct pdf_url) from occ)
        as pdfs_com_imagem, (select count(distinct sha256) from occ) as imagens_unicas, (select count(*) from groups)
        as grupos_duplicatas, (select count(*) from occ o where exists (select 1 from members m where m.sha256 = o.sha256
        and m.pdf_url = o.pdf_url and m.inep is not distinct from o.inep)) as imagens_duplicadas,
        (select count(distinct inep) from members where inep <> 0) as escolas_afetadas, (select count(*) from chained) as pares,
        (select count(*) from chained where similaridade = 100) as pares_exatos, (select count(*) from chained
        where similaridade < 100) as pares_visuais, (select count(distinct fornecedor) from groups where fornecedor <> '')
        as fornecedores_afetados, (select count(*) from occ) as supabase_analisados,
        (select count(*) from chained) as supabase_pares""",
    "chain_pairs": "select * from chained",
    "exact_pairs_inep": "select * from exact",
    "exact_pairs_file": "select * from filepairs",
    "pair_table_search": """select sha256, inep_a, inep_b from exact where fornecedor_a ilike '%ri1%'
        or fornecedor_b ilike '%ri1%'""",
    "pair_result_filter": """select sha256, inep_a, inep_b from exact where contains(lower(concat_ws(' ', fornecedor_a, inep_a,
        uf_a, pdf_filename_a)), 'mun3') or contains(lower(concat_ws(' ', fornecedor_b, inep_b, uf_b, pdf_filename_b)), 'mun3')""",
    "pair_defaults": """select sha256, inep_a, inep_b, case when (inep_a + inep_b) % 3 = 0 then left(sha256, 16) || '_1_0.jpg'
        else thumb_url_a end as thumb_url_a, tipo_duplicata, similaridade, distancia_hamming,
        case when (inep_a + inep_b) % 2 = 0 then 1 else pagina_b end as pagina_b from exact""",
    "audited_rows": """select occ_id, inep, pdf_url, sha256, g.ids is not null as tem_duplicata, coalesce(g.ids, '') as grupos
        from occ o left join (select inep as i, pdf_url as u, sha256 as s, string_agg(distinct grupo_id, ',' order by grupo_id)
        as ids from members group by 1, 2, 3) g on g.s = o.sha256 and g.u = o.pdf_url and g.i is not distinct from o.inep""",
    "audited_search": """select occ_id, inep, fornecedor from occ o where exists (select 1 from members m
        where m.sha256 = o.sha256 and m.pdf_url = o.pdf_url and m.inep is not distinct from o.inep)
        and contains(lower(fornecedor), 'ri1') and contains(lower(concat_ws(' ', coalesce(cast(inep as varchar), ''), uf,
        fornecedor, pdf_filename)), 'mun')""",
    "counterparts": """select m.inep, m.pdf_url, m.sha256, r.inep as outro_inep, arg_max(r.uf, m.seq) as outro_uf,
        arg_max(r.pagina, m.seq) as outro_pagina, arg_max(r.pdf_filename, m.seq) as outro_pdf_filename,
        arg_max(r.pdf_url, m.seq) as outro_pdf_url, arg_max(r.thumb_url, m.seq) as outro_thumb_url
        from members m join reps r on r.seq = m.seq and r.inep <> 0 and r.inep is distinct from m.inep group by 1, 2, 3, 4""",
    "scan_flags": """select occ_id, scan_id, scan_id in (select scan_id from used) or sha256 in (select sha256 from used)
        as tem_duplicata from scan""",
    "line_groups": f"""select 'G' || lpad(cast(row_number() over (order by qi desc, qo desc, s) as varchar), 5, '0') as grupo_id,
        'REDE' || case when lo = hi then ' / RE' || lo else '' end as fornecedor, qi as qtd_ineps, qo as qtd_ocorrencias from (
        select sha256(cast(l_partkey as varchar)) as s, count(distinct l_suppkey) as qi, count(*) as qo, min(l_suppkey % 5) as lo,
        max(l_suppkey % 5) as hi from lineitem group by 1 having count(distinct l_suppkey) > 1)""",
    "line_school_pairs": f"""select {FIRST} + a.s as inep_a, {FIRST} + b.s as inep_b, count(*) as imagens from lp a join lp b
        on a.p = b.p and a.s < b.s group by 1, 2""",
    "hamming_pairs": "select sha256_a, sha256_b, distancia from near where distancia <= 2",
    "hamming_pairs_wide": "select sha256_a, sha256_b, distancia from near",
    "hamming_distances": "select distancia, count(*) as pares from near group by 1",
    "visual_pairs": f"""select {', '.join(f'{s}.{c} as {c}_{s}' for s in 'ab' for c in ('occ_id', 'inep', 'pdf_filename',
        'pagina', 'sha256'))}, 'Visual (Perceptual)' as tipo_duplicata, {similarity('distancia')} as similaridade,
        distancia as distancia_hamming from visual where a.inep <> b.inep""",
    "visual_pairs_file": f"""select a.occ_id as occ_id_a, b.occ_id as occ_id_b, {similarity('distancia')} as similaridade,
        distancia as distancia_hamming from visual where a.pdf_filename <> b.pdf_filename""",
    "all_pairs_ranked": f"""select sha256 as sha256_a, inep_a, inep_b, tipo_duplicata, similaridade from exact union all
        select a.sha256, a.inep, b.inep, 'Visual (Perceptual)', {similarity('distancia')} from visual where a.inep <> b.inep""",
    "components": "select node as sha256, min(r) as rotulo from reach group by 1",
    "linkage_clusters": "select sha256, cluster from mixed",
    "mixed_groups": f"select {GROUP_COLUMNS} from groups_mix",
    "mixed_chain_pairs": "select * from chained_mix",
    "supplier_rollup": """select fornecedor, count(distinct kind || pair) as total_pairs, count(distinct pair) filter
        (where kind = 'e') as exact_pairs, count(distinct pair) filter (where kind = 'v') as visual_pairs, (select
        count(distinct i) from (select s2.inep as i, s2.fornecedor as f from schoolsides s2 union all select s2.other,
        s2.fornecedor from schoolsides s2) where f = s.fornecedor) as affected_ineps_count from schoolsides s group by 1""",
    "affected_schools": """select inep, arg_min(uf, {'f': fornecedor, 'u': uf}) as uf, min(fornecedor) as fornecedor,
        count(*) as duplicate_count, count(distinct pdf) as pdfs_count from schoolsides group by 1""",
    "affected_files": """select f as pdf_filename, count(*) as duplicate_count,
        array_to_string(list_sort(list(distinct p)), ',') as impacted_pages from filesides group by 1""",
    "scan_totals": """select (select count(*) from occ) as total_images, (select count(distinct sha256) from occ)
        as unique_hashes, (select count(distinct pdf_filename) from occ) as total_pdfs_analyzed, (select count(*)
        from filepairs) as exact_duplicate_pairs, (select count(*) from visual where a.pdf_filename <> b.pdf_filename)
        as visual_duplicate_pairs, (select count(distinct f) from filesides) as affected_files_count,
        (select count(*) from filepairs) + (select count(*) from visual where a.pdf_filename <> b.pdf_filename)
        as total_duplicate_pairs""",
    "all_supplier_totals_exact": """select nome, (select count(*) from scans s where s.nome = n.nome) as imagens,
        (select count(*) from sp where sp.nome = n.nome) as pares, (select count(distinct i) from (select nome as m, a as i
        from sp union all select nome, b from sp) where m = n.nome) as escolas_afetadas from sn n""",
    "accumulated_schools_exact": """select inep, nome as fornecedor, n as duplicate_count from (select inep, nome, count(*) as n from (
        select nome, a as inep from sp union all select nome, b from sp) group by 1, 2)
        qualify row_number() over (partition by inep order by nome) = 1""",
    "all_supplier_totals": """select nome, (select count(*) from scans s where s.nome = n.nome) as imagens,
        (select count(*) from ep where ep.nome = n.nome and kind = 'e') as exact_pairs,
        (select count(*) from ep where ep.nome = n.nome and kind = 'v') as visual_pairs,
        (select count(*) from ep where ep.nome = n.nome) as pares,
        (select count(distinct inep) from epsides s where s.nome = n.nome) as escolas_afetadas from sn n""",
    "accumulated_schools": """select inep, nome as fornecedor, n as duplicate_count from (select inep, nome, count(*) as n
        from epsides group by 1, 2) qualify row_number() over (partition by inep order by nome) = 1""",
    "supplier_list": f"select distinct unnest({names('fornecedor')}) as nome from register",
    "phase_counts": "select fase, count(*) as escolas from register where fase <> '' group by 1",
    "pair_images": f"""select inep_a, inep_b, grupo_id, grupo_fornecedor, sha256, exata, case when exata then 'Exata (100%)'
        else 'Visual' end as tipo, largura, altura, foto_camera, thumb_a, thumb_b, pagina_a, pagina_b, classe,
        {LABELS.format(c='classe')} as classe_rotulo, classe = 'foto' as evidencia from ci""",
    "pair_pdfs": """select inep_a, inep_b, lado, pdf_url, pdf_filename, inep, inep_no_nome, inep_divergente, fora_do_raio,
        com_coordenada, distancia_max_m, array_to_string(paginas, ',') as pgs from cpg""",
    "pair_fact": f"select {CASE_COLUMNS} from cases",
    "pair_fact_mixed": f"select {CASE_COLUMNS} from cases_mix",
    "pair_filter_tipo_visuais": "select par_id, qtd_imagens, qtd_exatas from cases_mix where not todas_exatas",
    **{f"pair_filter_{k}": f"select par_id, qtd_imagens, qtd_evidencias from cases where {w}" for k, w in FILTER_SQL.items()},
    "pair_summary": SUMMARY.format(t="cases", w="true"),
    "pair_summary_filtered": SUMMARY.format(
        t="cases", w="(qtd_evidencias > 0 or qtd_indefinidas > 0) and not falso_positivo"),
    "pair_by_supplier": "select nome, count(*) as valor from (select unnest(fornecedores) as nome from cases) group by 1",
    "pair_by_uf": """select nome, count(*) as valor from (select uf_a as nome from cases union all select uf_b from cases)
        where nome <> '' group by 1""",
    "pair_options": """select distinct tipo, valor from (select 'uf' as tipo, uf_a as valor from cases union all
        select 'uf', uf_b from cases union all select 'municipio', municipio_a from cases union all
        select 'municipio', municipio_b from cases union all select 'fornecedor', unnest(fornecedores) from cases)
        where valor <> ''""",
    "pair_page": """select par_id, qtd_evidencias, qtd_imagens, (select count(*) from cases) as total from cases order by qtd_evidencias desc, qtd_imagens desc, inep_a,
        inep_b limit 25""",
    "pair_export": f"""select inep_a as "INEP A", escola_a as "Escola A", uf_a as "UF A", municipio_a as "Municipio A",
        inep_b as "INEP B", escola_b as "Escola B", uf_b as "UF B", municipio_b as "Municipio B",
        array_to_string(fornecedores, ' / ') as "Fornecedor", qtd_imagens as "Imagens", qtd_exatas as "Exatas",
        qtd_evidencias as "Fotos de vistoria", array_to_string(list_transform(classes, lambda c: {LABELS.format(c='c')}), ' / ')
        as "Tipo de evidencia", fora_do_raio as "Fotos fora do raio",
        cast(round_even(distancia_max_m, 0) as bigint) as "Distancia max (m)",
        {YES.format(c='mesmo_municipio')} as "Mesmo municipio", {YES.format(c='mesmo_pdf')} as "Mesmo PDF nos dois",
        {YES.format(c='pdf_divergente')} as "PDF de outra escola", {YES.format(c='falso_positivo')} as "Falso positivo",
        grupos as "Grupos", array_to_string(nomes_pdf_a, ' | ') as "PDF A", array_to_string(nomes_pdf_b, ' | ') as "PDF B"
        from cases""",
    "coord_extract": "select s.sha256, s.texto, c.lat, c.lon from stamps s join coords c using (sha256)",
    "geo_photos": "select occ_id, pdf_url, flat as lat, flon as lon, reparado, distancia_m, situacao from located",
    "geo_pdf": "select * from geo",
    "geo_totals": """select count(*) as pdfs_com_coordenada, count(*) filter (where fora_do_raio > 0) as pdfs_com_foto_fora,
        coalesce(max(distancia_max_m) filter (where fora_do_raio > 0), 0.0) as distancia_max_m from geo""",
    "geo_largest": """select pdf_url, fora_do_raio, com_coordenada, distancia_max_m from geo where fora_do_raio > 0
        order by distancia_max_m desc, pdf_url limit 8""",
    "geo_top_pdfs": """select occ_id, pdf_url from photos where pdf_url in (select pdf_url from photos group by 1
        order by count(*) desc, pdf_url limit 20)""",
    "geo_case_photos": """select occ_id, pdf_url from photos where pdf_url in (select url_a from ci union all
        select url_b from ci)""",
    "geo_unread": """select sha256, min(thumb_url) as thumb_url from photos where sha256 not in (select sha256 from occ
        where fase = '5') group by 1""",
    "classify": f"select sha256, classe, {LABELS.format(c='classe')} as rotulo, classe = 'foto' as evidencia from classes",
    "classify_lineitem": f"""select classe, foto_camera, count(*) as imagens, cast(sum(l_linenumber) as bigint) as soma from (
        select *, {classify('w', 'h', '(case when l_quantity <> 13 then l_tax / 4 end)', '(l_extendedprice / 100000)',
        '(l_quantity / 8)', '(l_discount * 10)', '(l_discount * 300)', '(l_partkey % 12)', "(l_returnflag = 'R')")} as classe,
        {camera('w', 'h', '<=')} as foto_camera from (select *, cast(l_quantity * 40 as integer) as w, l_linenumber * 300 as h
        from lineitem)) group by 1, 2""",
    "phash_job": """select vec_id, cast((sum(case when v > m then power(2::double, 63 - i)::hugeint else 0 end) - case when
        max(case when i = 0 and v > m then 1 else 0 end) = 1 then 18446744073709551616 else 0 end) as bigint) as phash from (
        select *, median(v) over (partition by vec_id) as m from (select vec_id, u * 8 + w as i,
        sum(4 * p * cos(pi() * u * (2 * r + 1) / 64) * cos(pi() * w * (2 * c + 1) / 64)) as v
        from pixels, range(8) a(u), range(8) b(w) group by vec_id, u, w)) group by 1""",
    "dhash_job": """select a.vec_id, cast(sum(case when b.s > a.s then power(2::double, 63 - (a.i * 8 + a.j))::hugeint else 0
        end) - case when max(case when a.i = 0 and a.j = 0 and b.s > a.s then 1 else 0 end) = 1 then 18446744073709551616 else 0 end
        as bigint) as dhash from (select vec_id, r // 4 as i, j, sum(p * greatest(0, least(9 * (c + 1), 32 * (j + 1)) - greatest(9 * c, 32 * j)))
          as s from pixels, range(9) t(j) group by 1, 2, 3) a
        join (select vec_id, r // 4 as i, j, sum(p * greatest(0, least(9 * (c + 1), 32 * (j + 1)) - greatest(9 * c, 32 * j)))
          as s from pixels, range(9) t(j) group by 1, 2, 3) b on a.vec_id = b.vec_id and a.i = b.i and b.j = a.j + 1 group by 1""",
    "raster_measures": """select vec_id, 32 as largura, greatest(rows_same, cols_same) as uniformidade, chapado, gradiente,
        branco, saturacao, cores from
        (select vec_id, round_even(avg(case when m = 0 then 1.0::double else 0.0 end), 6) as rows_same from (select vec_id, r, max(d) as m
          from dy group by 1, 2) group by 1)
        join (select vec_id, round_even(avg(case when m = 0 then 1.0::double else 0.0 end), 6) as cols_same from (select vec_id, c, max(d)
          as m from dx group by 1, 2) group by 1) using (vec_id)
        join (select vec_id, round_even(avg(case when greatest(x.d, y.d) < 2 then 1.0::double else 0.0 end), 6) as chapado,
          round_even(avg(greatest(x.d, y.d)), 6) as gradiente from dx x join dy y using (vec_id, r, c) group by 1) using (vec_id)
        join (select vec_id, round_even(avg(case when least(p, 255 - p, p // 2) > 235 then 1.0::double else 0.0 end), 6) as branco,
          round_even(avg(greatest(p, 255 - p, p // 2) - least(p, 255 - p, p // 2)), 6) as saturacao,
          cast(count(distinct (p // 32) * 64 + ((255 - p) // 32) * 8 + (p // 2) // 32) as integer) as cores from pixels group by 1)
        using (vec_id)""",
    "parse_pdf_name": f"""select occ_id, {name_inep('n')} as inep_no_nome, {name_field('n', 2)} as uf,
        {name_field('n', 3)} as municipio, {name_school('n')} as escola,
        coalesce({name_inep('n')} <> 0 and {name_inep('n')} is distinct from inep, false) as divergente from (
        select occ_id, inep, case occ_id % 6 when 0 then '12009679 - AC - BUJARI - ESC A - B - T' || occ_id || '.PDF'
        when 1 then 'Aviso - ' || occ_id || '.pdf' when 2 then '12009679 - ac - X - Y' || occ_id else pdf_filename end as n
        from occ)""",
    "supplier_names": f"select inep, coalesce(array_to_string({names('fornecedor')}, '|'), '') as nomes from register",
    "explode_books": """select *, url_decode(replace(string_split(string_split(pdf_url, '/')[-1], '?')[1], '+', '%2B'))
        as pdf_filename from tasks""",
    "json_books": "select inep, unnest(books) as livro from register",
    "safe_names": """select sha256, inep, criado_em, 'Laudo_tecnico_n_' || doc_id || '_revisao.' || e as seguro,
        'Laudo técnico nº ' || doc_id || ' _ revisão.' || e as membro, case ext when 'pdf' then 'application/pdf'
        when 'zip' then 'application/zip' when 'jpeg' then 'image/jpeg'
        when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
        else 'application/octet-stream' end as mime from (select *, ['pdf', 'PDF', 'docx', 'exe', '', 'zip', 'jpeg'][doc_id % 7 + 1]
        as e from uploads)""",
    "identifiers": """select inep, 'fase' || replace(fase, '.', '_') || '_' || case when coalesce(fornecedor, '') = '' then 'todos'
        else lower(trim(left(regexp_replace(fornecedor, '[^A-Za-z0-9]', '_', 'g'), 24), '_')) end || '_'
        || strftime(atualizacao, '%Y%m%d_%H%M%S') as run_id, inep || 'x' || (inep + 1) as par_id,
        'aud_1_' || inep || '_' || strftime(atualizacao, '%Y%m%d_%H%M%S') as doc_id from register""",
    "register_export": f"select {FIELDS}, {REGISTER_FLAT} from export",
    "register_diff": f"""select acao, array_to_string(campos, ',') as campos, escola_id_bubble, {FIELDS}, {REGISTER_FLAT}
        from diff""",
    "register_to_send": "select escola_id_bubble, inep from diff where acao in ('novo', 'alterado')",
    "register_upsert": f"select escola_id_bubble, {FIELDS}, {REGISTER_FLAT} from merged",
    "register_orphans": "select inep, fase from register where inep not in (select inep from export)",
    "register_actions": """select acao, count(*) as linhas, count(*) filter (where list_contains(campos, 'books')) as com_books
        from diff group by 1""",
    "register_fields": "select campo, count(*) as linhas from (select unnest(campos) as campo from diff) group by 1",
    "register_new_by_phase": "select fase, count(*) as escolas from diff where acao = 'novo' group by 1",
    "forbidden_phases": "select distinct fase from export where fase <> '5'",
    "schools_of_phase": "select inep, uf, fornecedor from register where fase = '5' and fornecedor ilike '%re1%'",
    "schools_of_supplier": "select inep from register where fornecedor ilike '%ri3%' order by inep",
    "first_schools": "select inep, fase from register order by inep limit 20",
    "marks_state": "select * from marks",
    "marks_rejected": "select seq, par_id from mark_events where seq not in (select seq from good_events)",
    "marks_overlay": """select par_id, falso_positivo, mae_filho, motivo_codigo, motivo, left(marcado_em, 10) as marcado_em
        from overlay""",
    "lot_lines": """select envio_id, par_id, posicao, qtd_imagens, qtd_fotos_camera as qtd_fotos, mesmo_pdf,
        par_id as par_na_copia from lines""",
    "lot_summary": """select envio_id, count(*) as pares, cast(sum(qtd_imagens) as bigint) as imagens,
        cast(sum(qtd_fotos_camera) as bigint) as fotos_camera, count(*) filter (where mesmo_pdf) as mesmo_pdf,
        count(*) filter (where pdf_divergente) as pdf_divergente,
        len(list_distinct(flatten(list([inep_a, inep_b])))) as escolas,
        array_to_string(list_sort(list_distinct(flatten(list(fornecedores)))), '|') as fornecedores,
        array_to_string(list_sort(list_distinct(flatten(list([uf_a, uf_b])))), ',') as ufs from lines group by 1""",
    "lot_schools": "select distinct envio_id, unnest([inep_a, inep_b]) as inep from lines",
    "lot_evidence": """select envio_id, par_id, case when cast(envio_id[9:10] as integer) % 2 = 0 then 0
        when cast(envio_id[9:10] as integer) % 3 = 0 then 1 else 2 end as origem from selection""",
    "forwarded_flag": "select par_id, ja_encaminhado from cases",
    "doc_admission": """select motivo_recusa, count(*) as documentos, cast(sum(tamanho_bytes) as bigint) as bytes from admitted
        group by 1""",
    "doc_rows": "select * from ledger_docs",
    "docs_by_school": """select envio_id, inep, count(*) as documentos, cast(sum(tamanho_bytes) as bigint) as bytes,
        arg_max(doc_id, {'c': criado_em, 'd': doc_id}) as mais_recente from ledger_docs group by 1, 2""",
    "docs_newest": "select doc_id from ledger_docs order by criado_em desc, doc_id desc",
    "lot_delete": """select envio_id, count(*) as linhas, tabela from (
        select distinct envio_id, 'envios' as tabela from selection where envio_id <> 'aud_199803'
        union all select envio_id, 'pares' from selection where envio_id <> 'aud_199803'
        union all select * from (select 'aud_1998' || lpad(envio_id[5:6], 2, '0') as envio_id, 'documentos' from ledger_docs)
          where envio_id <> 'aud_199803'
        union all select distinct envio_id, 'eventos' from selection
        union all select 'aud_199803', 'eventos' where exists (select 1 from selection where envio_id = 'aud_199803'))
        group by envio_id, tabela""",
    "run_list": "select run_id, fonte, status, iniciado_em from runs order by iniciado_em desc, run_id desc",
    "runs_completed": "select run_id, fonte from runs where status = 'concluido'",
    "runs_missing": "select run_id, status from disk_runs where run_id not in (select run_id from stored_runs)",
    "rebuild_groups": f"""select 'G' || lpad(cast(row_number() over (order by qi desc, qo desc, cluster) as varchar), 5, '0')
        as grupo_id, cluster, coalesce(nome, first) as fornecedor, qi as qtd_ineps, qo as qtd_ocorrencias,
        1::bigint as qtd_shas, 'Exata (100%)' as tipo from (
        select sha256 as cluster, count(distinct inep) as qi, count(*) as qo, min(fornecedor) as first from pm group by 1
        having count(distinct inep) > 1) left join (select sha256 as cluster, string_agg(nome, ' / ' order by nome) as nome from (
        select sha256, nome from (select distinct sha256, inep, pagina, unnest({names('fornecedor')}) as nome from pm)
        join (select sha256, count(*) as n from pm group by 1) using (sha256) group by sha256, nome, n having count(*) = n)
        group by 1) using (cluster)""",
    "url_backfill": """select p.sha256, p.inep, p.pagina, coalesce(e.u, l.u) as pdf_url from (select * replace (case when
        pagina % 2 = 0 then pagina + 50 else pagina end as pagina) from pm) p
        left join (select sha256, inep, pagina, arg_max(pdf_url, occ_id) as u from occ group by 1, 2, 3) e
          on e.sha256 = p.sha256 and e.inep = p.inep and e.pagina = p.pagina
        left join (select sha256, inep, arg_min(pdf_url, occ_id) as u from occ group by 1, 2) l
          on l.sha256 = p.sha256 and l.inep = p.inep""",
    "missing_evidence": """select pdf_url, count(*) as arquivos from (select thumb_url, arg_max(pdf_url, {'s': seq, 'i':
        coalesce(inep, -1), 'f': pdf_filename, 'p': pagina, 'o': occ_id}) as pdf_url from members where thumb_url not in (
        select min(thumb_url) from occ group by sha256) group by 1) group by 1""",
    "day_scan": """select event_id, user_id from events where ts >= timestamp '2024-01-02' and ts < timestamp '2024-01-03'""",
    "fold_pages": """select pdf_url, xref, sha256, min(pagina) as pagina, array_to_string(list_sort(list(pagina)), ',') as paginas,
        count(*) as ocorrencias_no_pdf from exploded where w >= 120 and h >= 120 and not uniforme group by 1, 2, 3""",
    "pending_pdfs": """select inep, pdf_url from tasks where pdf_url not in (select pdf_url from tasks where uf = 'MA')""",
    "scope_counts": """select count(*) filter (where pdf_url in (select pdf_url from occ where uf = 'BA' and pdf_url not like
        '%shared%')) as no_recorte, count(*) filter (where pdf_url not in (select pdf_url from occ where uf = 'BA' and
        pdf_url not like '%shared%')) as fora_do_recorte from occ""",
    "new_contents": """select sha256, pdf_url, xref, pagina from exploded where sha256 not in (select sha256 from occ where fase = '5')
        qualify row_number() over (partition by sha256 order by pdf_url, xref, pagina) = 1""",
    "thumbnails": """select distinct sha256, first_value(left(sha256, 16) || '_' || pagina || '_' || xref || '.jpg') over (
        partition by sha256 order by pdf_url, pagina, xref) as thumb_url from exploded""",
    "manifest": """select grupo_id, thumb_url, grupo_id || '/INEP' || coalesce(cast(inep as varchar), 'None') || '_' || uf || '_p'
        || pagina || '_' || left(pdf_filename, 70) || '.jpg' as destino from members""",
    "report_summary_exact": """select 'Total de Escolas Analisadas' as "Métrica", (select count(*) from register) as "Valor"
        union all select 'Total de Imagens Extraídas', (select count(*) from occ)
        union all select 'Pares de Duplicatas Encontrados', (select count(*) from exact)
        union all select 'Duplicatas Exatas (100%)', (select count(*) from exact where similaridade = 100)
        union all select 'Duplicatas Visuais (<100%)', (select count(*) from exact where similaridade < 100)""",
    "report_schools_exact": """select inep, min(uf) as uf, min(fornecedor) as fornecedor, count(*) as count from (select inep_a as inep,
        uf_a as uf, fornecedor_a as fornecedor from exact union all select inep_b, uf_b, fornecedor_b from exact) group by 1""",
    "report_pairs_exact": """select tipo_duplicata as "Tipo Duplicata", '100.0%' as "Similaridade (%)", distancia_hamming as
        "Distância Hamming", inep_a as "INEP A", uf_a as "UF A", fornecedor_a as "Fornecedor A", pdf_filename_a as "PDF A",
        pagina_a as "Página A", inep_b as "INEP B", uf_b as "UF B", fornecedor_b as "Fornecedor B", pdf_filename_b as "PDF B",
        pagina_b as "Página B", sha256 as "SHA256 Imagem" from exact""",
    "report_summary": """select 'Total de Escolas Analisadas' as "Métrica", (select count(*) from register) as "Valor"
        union all select 'Total de Imagens Extraídas', (select count(*) from occ)
        union all select 'Pares de Duplicatas Encontrados', (select count(*) from allpairs)
        union all select 'Duplicatas Exatas (100%)', (select count(*) from allpairs where similaridade = 100)
        union all select 'Duplicatas Visuais (<100%)', (select count(*) from allpairs where similaridade < 100)""",
    "report_schools": """select inep, min(uf) as uf, min(fornecedor) as fornecedor, count(*) as count from (
        select inep_a as inep, uf_a as uf, fornecedor_a as fornecedor from allpairs
        union all select inep_b, uf_b, fornecedor_b from allpairs) group by 1""",
    "report_pairs": """select tipo_duplicata as "Tipo Duplicata", cast(cast(similaridade as double) as varchar) || '%'
        as "Similaridade (%)", distancia_hamming as "Distância Hamming", inep_a as "INEP A", uf_a as "UF A",
        fornecedor_a as "Fornecedor A", pdf_filename_a as "PDF A", pagina_a as "Página A", inep_b as "INEP B", uf_b as "UF B",
        fornecedor_b as "Fornecedor B", pdf_filename_b as "PDF B", pagina_b as "Página B", sha256 as "SHA256 Imagem"
        from allpairs""",
}
CTES.update({
    "lp": "select distinct l_partkey as p, l_suppkey as s from lineitem",
    "scan": "select *, coalesce(inep, occ_id) || '_p' || pagina || '_i' || (occ_id % 7) as scan_id from occ",
    "used": f"""select s.sha256, s.scan_id from scan s join shared using (cluster) where s.inep <> 0
        qualify row_number() over (partition by s.sha256, s.inep order by s.pdf_filename, s.pagina, s.occ_id) = 1""",
    "sn": f"select distinct unnest({names('fornecedor')}) as nome from register",
    "scans": "select o.*, n.nome from occ o join sn n on contains(lower(o.fornecedor), lower(n.nome))",
    "sp": """select distinct a.nome, a.sha256, a.inep as a, b.inep as b from scans a join scans b on a.nome = b.nome
        and a.sha256 = b.sha256 and a.inep < b.inep""",
    "hscans": "select o.*, n.nome from hocc o join sn n on contains(lower(o.fornecedor), lower(n.nome)) where o.inep <> 0",
    "vp": """select a.nome, a.inep as a, b.inep as b from near d join hscans a on a.sha256 = d.sha256_a
        join hscans b on b.sha256 = d.sha256_b and b.nome = a.nome where a.inep <> b.inep""",
    "ep": "select nome, a, b, 'e' as kind from sp union all select nome, a, b, 'v' from vp",
    "epsides": "select nome, a as inep from ep union all select nome, b from ep",
    "allpairs": f"""select tipo_duplicata, similaridade, distancia_hamming, inep_a, uf_a, fornecedor_a, pdf_filename_a, pagina_a,
        inep_b, uf_b, fornecedor_b, pdf_filename_b, pagina_b, sha256 from exact
        union all select 'Visual (Perceptual)', {similarity('distancia')}, distancia, a.inep, a.uf, a.fornecedor, a.pdf_filename,
        a.pagina, b.inep, b.uf, b.fornecedor, b.pdf_filename, b.pagina, a.sha256
        from visual where a.inep <> b.inep and a.inep <> 0 and b.inep <> 0""",
    "pm0": """select sha256, inep_a as inep, pagina_a as pagina, uf_a as uf, fornecedor_a as fornecedor,
        pdf_filename_a as pdf_filename, thumb_url_a as thumb_url, coalesce(inep_a, 0) as q, 0 as lado from chained union all
        select sha256, inep_b, pagina_b, uf_b, fornecedor_b, pdf_filename_b, thumb_url_b, coalesce(inep_a, 0), 1 from chained""",
    "pm": """select * from pm0 where inep <> 0
        qualify row_number() over (partition by sha256, inep, pagina order by q desc, lado desc) = 1""",
})


def _needs(body: str) -> list[str]:
    words = set(re.findall(r"\b(?:from|join)\s+\(?\s*([a-z_0-9]+)", body)) | set(re.findall(r",\s*([a-z_0-9]+)\s+[a-z]\b", body))
    return [w for w in words if w in CTES]


def assemble(final: str) -> str:
    """Prefix the select with the sub-queries it refers to, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _needs(CTES[name]):
            if other != name:
                visit(other)
        ordered.append(name)

    for name in _needs(final):
        visit(name)
    parts = ",\n".join(f"{n} as ({CTES[n]})" for n in ordered)
    return f"with recursive {parts}\n{final}" if parts else final


from reprise.plans import stores_sql  # noqa: E402 - needs the names above

for _name in ("all_supplier_totals", "accumulated_schools", "report_summary", "report_schools", "report_pairs"):
    SELECTS[f"{_name}_visual"] = SELECTS[_name]  # the name of before
CTES.update(stores_sql.CTES)
SELECTS.update(stores_sql.SELECTS)


def oracle_sql() -> dict[str, str]:
    return {name: assemble(sql) for name, sql in SELECTS.items()}
