"""The queries as SQL for an independent engine. The statements follow the definitions (pairs, dense vectors and windows
written out) and not the way the Spark jobs compute them."""

from appconv.catalogue import windows as W
from appconv.names import BINNING

_COHORT = "country_id, device_os_id, device_type_id"
_REQUEST = (
    "request_date, request_uid, display_marketing_name, os_version_id, market_id, device_os_id, country_id, device_type_id"
)
_SEGMENT = (
    "request_date, market_id, display_marketing_name, os_version_id, country_id, device_type_id, device_os_id"
)
_MODEL_SEGMENT = "request_date, display_marketing_name, os_version_id, market_id"
_FEATURES = "display_marketing_name, os_version_id, market_id, app_id, appOwnCVUEnc"
_FEATURE_LIST = ["display_marketing_name", "os_version_id", "market_id", "app_id", "appOwnCVUEnc"]
_NEWTON_STEPS = 300
_VECTOR = "'Array(' || " + " || ', ' || ".join(f"((mask >> {i}) & 1)" for i in range(9)) + " || ')'"
_DIGITS = " || ".join(f"((mask >> {i}) & 1)" for i in range(9))

# Common table expressions in order of dependency; a query takes all of them up to the ones it names.
_TABLES = {
    "requests_all": """
        select distinct strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as request_date,
               cast(o_custkey as varchar) as request_uid,
               case when c_custkey % 20 = 0 then '' else c_mktsegment end as display_marketing_name,
               o_orderpriority as os_version_id, cast(c_nationkey as varchar) as market_id,
               o_orderstatus as device_os_id, cast(n_regionkey as varchar) as country_id,
               case when c_acctbal < 0 then '3' else '1' end as device_type_id
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "events_all": """
        select cast(o_custkey as varchar) as request_uid, cast(l_partkey as varchar) as app_gpm_id,
               strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as request_date, l_returnflag as kind
        from lineitem join orders on l_orderkey = o_orderkey""",
    "raw_map": """
        select cast(p_partkey as varchar) as app_gpm_id,
               case when p_size = 50 then 'NULL' else p_brand || '/' || p_type end as app_id
        from part""",
    "app_map": "select distinct app_gpm_id, app_id from raw_map where app_gpm_id <> 'NULL' and app_id <> 'NULL'",
    "owned": f"""
        select distinct request_uid, app_id from events_all join app_map using (app_gpm_id)
        where request_date <= '{W.OWNED_END}'""",
    "lately": f"""
        select distinct request_uid, app_id from events_all join app_map using (app_gpm_id)
        where kind = 'N' and request_date between '{W.TARGET_START}' and '{W.TARGET_END}'""",
    "ownership": "select distinct request_uid, app_id, r.* exclude (request_uid) from owned join requests_all r using (request_uid)",
    "target": "select distinct request_uid, app_id, r.* exclude (request_uid) from lately join requests_all r using (request_uid)",
    "own": f"select distinct {_COHORT}, request_uid, app_id from ownership",
    "tgt": f"select distinct {_COHORT}, request_uid, app_id from target",
    "requests": f"select * from requests_all where request_date between '{W.TRAIN_START}' and '{W.TEST_DAY}'",
    "downloads": f"""
        select distinct request_uid, app_id, request_date from events_all join app_map using (app_gpm_id)
        where kind = 'N' and request_date between '{W.TRAIN_START}' and '{W.TEST_DAY}'""",
    "attributed": "select distinct d.*, r.* exclude (request_uid, request_date) from downloads d join requests r using (request_date, request_uid)",
    "bags": "select request_uid, array_to_string(list_sort(list(distinct app_id)), ',') as appsbag from owned group by all",
    "users_a1": f"select {_COHORT}, app_id as app_a1, count(*) as A1users from own group by all",
    "users_a0": f"select {_COHORT}, app_id as app_a0, count(*) as A0users from tgt group by all",
    "reach": f"select {_COHORT}, count(distinct request_uid) as RONusers from own group by all",
    "pairs": f"""
        select {_COHORT}, app_a0, app_a1, A0users, A1users
        from users_a1 join users_a0 using ({_COHORT})
        where A1users >= {W.MIN_USERS} and A0users >= {W.MIN_USERS} and app_a0 <> app_a1""",
    "together": f"""
        select {_COHORT}, t.app_id as app_a0, o.app_id as app_a1, count(*) as A1A0users
        from own o join tgt t using ({_COHORT}, request_uid) where o.app_id <> t.app_id group by all""",
    "counted": f"""
        select {_COHORT}, app_a0, app_a1, A0users, A1users, coalesce(A1A0users, 0) as A1A0users, RONusers
        from pairs left join together using ({_COHORT}, app_a0, app_a1) join reach using ({_COHORT})""",
    "totalled": f"""
        select *, cast(sum(A1A0users) over w as bigint) as A1A0usersAggTarget,
               cast(sum(A1users) over w as bigint) as A1usersAggTarget
        from counted window w as (partition by {_COHORT}, app_a0)""",
    "lifted": """
        select *, cast(A1A0users as double) * cast(A1usersAggTarget as double)
                  / nullif(cast(A1A0usersAggTarget as double) * cast(A1users as double), 0) as nCVU
        from totalled""",
    "binned": "select *, case when nCVU > 0 then cast(floor(log2(nCVU)) as bigint) end as log_norm_cvu_ROUNDED from lifted",
    "feed": """
        select * exclude (nCVU, log_norm_cvu_ROUNDED), coalesce(nCVU, -999.0) as nCVU,
               coalesce(log_norm_cvu_ROUNDED, -999) as log_norm_cvu_ROUNDED
        from binned""",
    "slots": f"""
        select {_COHORT}, app_a0, app_a1,
               cast(least(greatest(log_norm_cvu_ROUNDED, -3), 5) + 3 as integer) as log_norm_cvu_ROUNDED
        from feed""",
    "popular": f"select app_id from downloads group by app_id having count(request_uid) >= {W.MIN_ROWS}",
    "user_vectors": f"""
        select m.*, app_a0, bit_or(1 << log_norm_cvu_ROUNDED) as mask
        from (select distinct {_COHORT}, request_uid from requests) m join owned using (request_uid)
             join slots on slots.country_id = m.country_id and slots.device_os_id = m.device_os_id
                       and slots.device_type_id = m.device_type_id and slots.app_a1 = owned.app_id
        group by all""",
    "dense": f"""
        select r.*, p.app_id, coalesce(v.mask, 0) as mask
        from requests r cross join popular p
             left join user_vectors v on v.country_id = r.country_id and v.device_os_id = r.device_os_id
                  and v.device_type_id = r.device_type_id and v.request_uid = r.request_uid and v.app_a0 = p.app_id""",
    "own_vector": """
        select a.*, coalesce(v.mask, 0) as mask
        from attributed a
             left join user_vectors v on v.country_id = a.country_id and v.device_os_id = a.device_os_id
                  and v.device_type_id = a.device_type_id and v.request_uid = a.request_uid and v.app_a0 = a.app_id""",
    "plain": f"""
        select u.*, app_id, coalesce(downloads, 0) as downloads, coalesce(downloads * 1.0::double / user_count, 0) as CVU
        from (select {_SEGMENT}, count(*) as user_count from requests group by all) u
             left join (select {_SEGMENT}, app_id, count(*) as downloads from attributed group by all) d
             using ({_SEGMENT})""",
    "bagged": "select r.*, appsbag from requests r join bags using (request_uid)",
    "by_bag": f"""
        select u.*, app_id, downloads, downloads * 1.0::double / user_count as CVU
        from (select {_SEGMENT}, appsbag, count(*) as user_count from bagged group by all) u
             join (select {_SEGMENT}, appsbag, app_id, count(*) as downloads
                   from bagged join downloads using (request_date, request_uid) group by all) d
             using ({_SEGMENT}, appsbag)""",
    "encoded": f"""
        select {_SEGMENT}, app_id, {_VECTOR} as appOwnCVUEnc, user_count, coalesce(downloads, 0) as downloads,
               coalesce(downloads * 1.0::double / user_count, 0) as CVU
        from (select {_SEGMENT}, app_id, mask, count(*) as user_count from dense group by all) u
             left join (select {_SEGMENT}, app_id, mask, count(*) as downloads
                        from dense join downloads using (request_date, request_uid, app_id) group by all) d
             using ({_SEGMENT}, app_id, mask)""",
    "appfree": f"""
        select {_MODEL_SEGMENT}, app_id, {_VECTOR} as appOwnCVUEnc, user_count, downloads,
               downloads * 1.0::double / user_count as CVU
        from (select {_MODEL_SEGMENT}, mask, count(*) as user_count
              from dense where request_uid in (select request_uid from owned) group by all) u
             join (select {_MODEL_SEGMENT}, app_id, mask, count(*) as downloads from own_vector group by all) d
             using ({_MODEL_SEGMENT}, mask)""",
    "model_rows": """
        select * replace (case when display_marketing_name = '' then 'NA' else display_marketing_name end
                          as display_marketing_name)
        from appfree""",
    "train": f"select * from model_rows where request_date between '{W.TRAIN_START}' and '{W.TRAIN_END}'",
    "test": f"select * from model_rows where request_date = '{W.TEST_DAY}'",
    "instances": """
        select m.*, 0 as label, cast(greatest(user_count - downloads, 0) as double) as weight from model_rows m
        union all
        select m.*, 1 as label, cast(downloads as double) as weight from model_rows m""",
    "train_bins": f"""
        select {_FEATURES}, cast(sum(downloads) as bigint) as downloads, cast(sum(user_count) as bigint) as user_count,
               cast(sum(downloads) as double) / cast(sum(user_count) as double) as CVU
        from train group by all""",
    "test_bins": f"""
        select {_FEATURES}, cast(sum(downloads) as bigint) as downloads, cast(sum(user_count) as bigint) as user_count,
               cast(sum(downloads) as double) / cast(sum(user_count) as double) as CVU
        from test group by all""",
    "cells": f"""
        select {_FEATURES}, b.CVU as {BINNING}, t.user_count, t.CVU
        from train_bins b join test_bins t using ({_FEATURES})""",
    "categories": " union all ".join(
        f"select {n} as pos, '{c}' as feature, {c} as label, count(*) as n from model_rows group by {c}"
        for n, c in enumerate(_FEATURE_LIST)
    ),
    "indexed": """
        select pos, feature, label,
               cast(row_number() over (partition by feature order by n desc, label) - 1 as integer) as index
        from categories""",
    # The most likely main effects by Newton steps on one category at a time, whose values do not depend on each other; they
    # settle to 1e-9 within 20 rounds over the five.
    "train_cells": f"""
        select {_FEATURES}, sum(downloads)::double as y, sum(greatest(user_count, downloads))::double as w from train group by all""",
    "newton": f"""
        select 0 as step, '' as level, 0.0::double as delta, *, 0.0::double as eta from train_cells
        union all
        select step + 1, next, least(2, greatest(-2, gain)), {_FEATURES}, y, w, eta + least(2, greatest(-2, gain))
        from (select *, sum(y - w * p) over (partition by next) / greatest(1e-12, sum(w * p * (1 - p)) over (partition by next)) as gain
              from (select *, 1 / (1 + exp(-eta)) as p,
                           case step % 5 {" ".join(f"when {n} then {c}" for n, c in enumerate(_FEATURE_LIST))} end as next
                    from newton where step < {_NEWTON_STEPS}))""",
    "effects": """
        select pos, level, sum(delta) as effect
        from (select step, (step - 1) % 5 as pos, level, any_value(delta) as delta from newton where step > 0 group by all)
        group by all""",
    "modelled": f"""
        select m.*, 1 / (1 + exp(-({" + ".join(f"e{n}.effect" for n in range(len(_FEATURE_LIST)))}))) as p
        from model_rows m {" ".join(
            f"left join effects e{n} on e{n}.pos = {n} and e{n}.level = m.{c}" for n, c in enumerate(_FEATURE_LIST))}""",
    "widths": "select pos, feature, count(*) - 1 as width from indexed group by all",
    "offsets": """
        select feature, width, cast(coalesce(sum(width) over (
                   order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as start
        from widths""",
}


def _sql(select: str, needs: str) -> str:
    names = list(_TABLES)
    upto = names.index(needs) + 1
    with_ = ",\n".join(f"{n} as ({_TABLES[n].strip()})" for n in names[:upto])
    return f"with {'recursive ' if 'newton' in names[:upto] else ''}{with_}\n{select}"


_STATEMENTS = {
    "parse_event_log": ("select request_uid, app_gpm_id, request_date from events_all", "events_all"),
    "request_log": ("select * from requests_all", "requests_all"),
    # An empty cell of a CSV file is a missing one.
    "request_csv": (
        "select * replace (nullif(display_marketing_name, '') as display_marketing_name) from requests_all",
        "requests_all",
    ),
    "app_map_csv": ("select * from app_map", "app_map"),
    "requests_by_day": (
        "select * replace ('2000-01-' || substr(request_date, 6, 2) as request_date) from requests",
        "requests",
    ),
    "orc_events": (
        "select distinct request_uid, app_gpm_id as app_id, '2000-01-' || substr(request_date, 6, 2) as request_date "
        f"from events_all where kind = 'N' and request_date between '{W.TRAIN_START}' and '{W.TEST_DAY}'",
        "events_all",
    ),
    "app_map": ("select * from app_map", "app_map"),
    "requests": ("select * from requests_all", "requests_all"),
    "event_window": (
        "select request_uid, app_gpm_id, request_date from events_all where kind = 'N' "
        f"and request_date between '{W.TARGET_START}' and '{W.TARGET_END}'",
        "events_all",
    ),
    "cohort_filtered": (
        "select * from requests_all where country_id = '1' and (device_os_id = 'O' or device_os_id = 'F') "
        "and (device_type_id = '1' or device_type_id = '3')",
        "requests_all",
    ),
    "union_events": (
        f"select distinct request_uid, app_gpm_id, request_date from events_all where request_date <= '{W.OWNED_END}'",
        "events_all",
    ),
    "map_store_ids": (
        "select request_uid, request_date, app_id from events_all join app_map using (app_gpm_id) "
        f"where request_date <= '{W.OWNED_END}'",
        "app_map",
    ),
    "owned_apps": ("select * from owned", "owned"),
    "ownership": ("select * from ownership", "ownership"),
    "targets": ("select * from target", "target"),
    "cohort_apps": ("select * from own", "own"),
    "attribute_downloads": ("select * from attributed", "attributed"),
    "app_bags": ("select * from bags", "bags"),
    "market_bags": (
        "select request_uid, array_to_string(list_sort(list(distinct market_id)), ',') as appsbag from ownership group by all",
        "ownership",
    ),
    "requests_with_bags": ("select r.*, appsbag from requests r left join bags using (request_uid)", "bags"),
    "requests_of_owners": ("select * from bagged", "bagged"),
    "downloads_with_bags": ("select a.*, appsbag from attributed a left join bags using (request_uid)", "bags"),
    "bag_stats": (
        "select count(*) as bags, round(avg(n), 6) as avg_apps from (select count(*) as n from owned group by request_uid)",
        "owned",
    ),
    "cohort_counts": (f"select {_COHORT}, count(*) as count from ownership group by all", "ownership"),
    "cohort_reach": ("select * from reach", "reach"),
    "app_users": ("select * from users_a1", "users_a1"),
    "target_users": ("select * from users_a0", "users_a0"),
    "eligible_pairs": (f"select {_COHORT}, app_a1, app_a0 from pairs", "pairs"),
    "co_users": (
        f"select {_COHORT}, app_a0, app_a1, A1A0users from together join pairs using ({_COHORT}, app_a0, app_a1)",
        "together",
    ),
    "pair_counts": ("select * from totalled", "totalled"),
    "pair_lift": (f"select {_COHORT}, app_a0, app_a1, nCVU, log_norm_cvu_ROUNDED from binned", "binned"),
    "lift_feed": ("select * from feed", "feed"),
    "lift_feed_legacy": (
        """select * exclude (nCVU, log_norm_cvu_ROUNDED), coalesce(nCVU, -999.0) as nCVU,
                  case when A1A0usersAggTarget = 0 then 0 else coalesce(log_norm_cvu_ROUNDED, -999) end as log_norm_cvu_ROUNDED
           from binned""",
        "binned",
    ),
    "feed_slots": ("select * from slots", "slots"),
    "lift_stats": (
        f"""select {_COHORT}, eligible_owned, eligible_targets, coalesce(pairs, 0) as pairs
            from (select {_COHORT}, cast(sum(o) as bigint) as eligible_owned, cast(sum(t) as bigint) as eligible_targets
                  from (select {_COHORT}, 1 as o, 0 as t from users_a1 where A1users >= {W.MIN_USERS} union all
                        select {_COHORT}, 0 as o, 1 as t from users_a0 where A0users >= {W.MIN_USERS}) group by all)
                 left join (select {_COHORT}, count(*) as pairs from pairs group by all) using ({_COHORT})""",
        "pairs",
    ),
    "popular_targets": ("select * from popular", "popular"),
    "target_hits": (
        f"select {_COHORT}, request_uid, app_a0, {_DIGITS} as slots from user_vectors "
        "where app_a0 in (select app_id from popular)",
        "user_vectors",
    ),
    "encode_own_target": (
        f"select * exclude (mask), {_VECTOR} as appOwnCVUEnc from own_vector",
        "own_vector",
    ),
    "encode_all_targets": (f"select * exclude (mask), {_VECTOR} as appOwnCVUEnc from dense", "dense"),
    "count_users": (f"select {_SEGMENT}, count(*) as user_count from requests group by all", "requests"),
    "count_downloads": (f"select {_SEGMENT}, app_id, count(*) as downloads from attributed group by all", "attributed"),
    "cvu_plain": ("select * from plain", "plain"),
    "cvu_by_bag": ("select * from by_bag", "by_bag"),
    "cvu_encoded": ("select * from encoded", "encoded"),
    "cvu_encoded_sparse": ("select * from encoded", "encoded"),
    "cvu_encoded_appfree": ("select * from appfree", "appfree"),
    "cvu_encoded_appfree_min_users": (f"select * from appfree where user_count >= {W.LEAST_USERS}", "appfree"),
    "table_sizes": (
        "select 'plain' as table_name, count(*) as rows from plain union all "
        "select 'by_bag', count(*) from by_bag union all select 'encoded', count(*) from encoded",
        "encoded",
    ),
    "fill_missing": (
        "select * replace (case when display_marketing_name = '' then 'NA' else display_marketing_name end "
        "as display_marketing_name) from requests",
        "requests",
    ),
    "temporal_split": (
        "select *, 'train' as part from train union all select *, 'test' as part from test",
        "test",
    ),
    "expand_instances": ("select * from instances", "instances"),
    "training_cells": (
        f"select {_FEATURES}, label, sum(weight) as weight from instances "
        f"where request_date between '{W.TRAIN_START}' and '{W.TRAIN_END}' group by all",
        "instances",
    ),
    "string_index": ("select feature, label, index from indexed", "indexed"),
    "feature_slots": (
        f"""select {_FEATURES}, cast((select sum(width) from widths) as integer) as width,
                   array_to_string(list_filter([{", ".join(
                       f"(select case when i.index < o.width then o.start + i.index end from indexed i join offsets o "
                       f"using (feature) where i.feature = '{c}' and i.label = c.{c})" for c in _FEATURE_LIST)}],
                   lambda p: p is not null), ',') as ones
            from (select distinct {_FEATURES} from model_rows) c""",
        "offsets",
    ),
    "binning_rates": ("select * from train_bins", "train_bins"),
    "binning_cells": ("select * from cells", "cells"),
    "binning_rmse": (
        f"""select round(sum(user_count * (CVU - {BINNING}) * (CVU - {BINNING})), 6) as weighted_error,
                  cast(sum(user_count) as bigint) as weight,
                  round(sqrt(sum(user_count * (CVU - {BINNING}) * (CVU - {BINNING}))
                             / sum(user_count)), 6) as rmse
           from cells""",
        "cells",
    ),
    "lr_calibration": ("select market_id, cast(sum(downloads) as bigint) as downloads from train group by all", "train"),
}

_STATEMENTS["target_hits_shuffled"] = _STATEMENTS["target_hits"]
_STATEMENTS["target_hits_compact"] = _STATEMENTS["target_hits"]
_STATEMENTS["requests_redone_day"] = ("select * from requests", "requests")
_STATEMENTS["cohort_apps_bucketed"] = _STATEMENTS["cohort_apps"]
_STATEMENTS["requests_with_bags_bucketed"] = _STATEMENTS["requests_with_bags"]
_STATEMENTS["owned_apps_sliding"] = (
    " union all ".join(
        f"select distinct request_uid, app_id, '{end}' as window_end from events_all join app_map using (app_gpm_id) "
        f"where request_date between '{start}' and '{end}'"
        for start, end in W.SLIDING
    ),
    "app_map",
)
_STATEMENTS["feed_preview"] = (
    f"select * from feed order by nCVU desc, A1A0users desc, {_COHORT}, app_a0, app_a1 limit 20",
    "feed",
)
_STATEMENTS["feed_counts"] = (
    """select count(*) as pairs, count(*) filter (A1A0users > 0) as co_owned, count(*) filter (log_norm_cvu_ROUNDED <> -999) as with_bin,
              sum(A1A0users)::bigint as co_users from feed""",
    "feed",
)
_STATEMENTS["cvu_encoded_compact"] = _STATEMENTS["cvu_encoded"]
_STATEMENTS["cvu_encoded_appfree_compact"] = _STATEMENTS["cvu_encoded_appfree"]
_STATEMENTS["encode_own_target_compact"] = _STATEMENTS["encode_own_target"]
_STATEMENTS["lift_feed_unfolded"] = _STATEMENTS["lift_feed"]
_STATEMENTS["string_index_table"] = _STATEMENTS["string_index"]
_STATEMENTS["feature_slots_table"] = _STATEMENTS["feature_slots"]
_STATEMENTS["lift_feed_compact"] = (
    f"""select {_COHORT}, app_a0, app_a1, cast(least(greatest(log_norm_cvu_ROUNDED, -3), 5) + 3 as integer) as log_norm_cvu_ROUNDED
        from feed where A1A0users > 0
        union all
        select {_COHORT}, app_a0, null, 0
        from (select {_COHORT}, app_a0 from users_a0 where A0users >= {W.MIN_USERS})
             semi join (select {_COHORT} from users_a1 where A1users >= {W.MIN_USERS}) using ({_COHORT})""",
    "slots",
)

# One category, no regularisation: the most likely rate of each value is its ratio.
_RATIO = """
    (select market_id, sum(downloads)::double / sum(greatest(user_count, downloads))::double as p from train group by all)"""
_ERROR = "sum(user_count * (CVU - p) * (CVU - p))"
_RMSE = f"round({_ERROR}, 4) as weighted_error, sum(user_count)::bigint as weight, round(sqrt({_ERROR} / sum(user_count)), 6) as rmse"
_STATEMENTS["lr_scores"] = (
    f"select t.*, round(p, 6) as logistic_prediction from test t join {_RATIO} using (market_id)",
    "test",
)
_STATEMENTS["lr_scores_fit_on_all"] = _STATEMENTS["lr_scores"]
_STATEMENTS["lr_train_rmse"] = (f"select {_RMSE} from train t join {_RATIO} using (market_id)", "train")
_STATEMENTS["compare_models"] = (
    f"""select model, count(*) as cells, {_RMSE}
        from (select b.market_id, b.user_count, b.CVU, unnest(['logistic', 'binning']) as model, unnest([r.p, a.CVU]) as p
              from (select market_id, sum(downloads)::double / sum(user_count)::double as CVU from train group by all) a
                   join (select market_id, sum(user_count)::bigint as user_count,
                                sum(downloads)::double / sum(user_count)::double as CVU from test group by all) b using (market_id)
                   join {_RATIO} r using (market_id))
        group by model""",
    "test",
)
_STATEMENTS["lr_calibration_all"] = (
    " union all ".join(
        f"select '{c}' as feature, {c} as label, sum(downloads)::bigint as downloads, 0.0::double as error from train group by {c}"
        for c in _FEATURE_LIST
    ),
    "train",
)

_ERRORS = f"""round({_ERROR}, 3) as weighted_error, sum(user_count)::bigint as weight,
                  round(sqrt({_ERROR} / sum(user_count)), 5) as rmse"""
_STATEMENTS["lr_scores_all"] = (
    f"select * exclude (p), round(p, 4) as logistic_prediction from modelled where request_date = '{W.TEST_DAY}'",
    "modelled",
)
_STATEMENTS["lr_train_rmse_all"] = (
    f"select {_ERRORS} from modelled where request_date between '{W.TRAIN_START}' and '{W.TRAIN_END}'",
    "modelled",
)
_STATEMENTS["compare_models_all"] = (
    f"""select model, count(*) as cells, {_ERRORS}
        from (select c.user_count, c.CVU, unnest(['logistic', 'binning']) as model, unnest([m.p, c.{BINNING}]) as p
              from cells c join (select distinct {_FEATURES}, p from modelled where request_date = '{W.TEST_DAY}') m
                   using ({_FEATURES}))
        group by model""",
    "modelled",
)

_COARSE = ", ".join(W.COARSE)
_RATES = f"select {_COARSE}, sum(user_count)::bigint as user_count, sum(downloads)::double / sum(user_count)::double as CVU"
_STATEMENTS["binning_cells_coarse"] = (
    f"select {_COARSE}, a.CVU as {BINNING}, b.user_count, b.CVU from ({_RATES} from train group by all) a "
    f"join ({_RATES} from test group by all) b using ({_COARSE})",
    "test",
)

_UNNAMED = f"""
    select u.*, app_id, coalesce(downloads, 0) as downloads, coalesce(downloads * 1.0::double / user_count, 0) as CVU
    from (select {_SEGMENT}, count(*) as user_count
          from (select * replace (nullif(display_marketing_name, '') as display_marketing_name) from requests)
          group by all) u
         left join (select {_SEGMENT}, app_id, count(*) as downloads
          from (select * replace (nullif(display_marketing_name, '') as display_marketing_name) from attributed)
          group by all) d on """


def _unnamed(equal: str) -> tuple[str, str]:
    return _UNNAMED + " and ".join(f"u.{c} {equal} d.{c}" for c in _SEGMENT.split(", ")), "attributed"


_STATEMENTS["cvu_plain_unknown_device"] = _unnamed("=")
_STATEMENTS["cvu_plain_null_safe"] = _unnamed("is not distinct from")


def oracle_sql() -> dict[str, str]:
    return {name: _sql(select, needs) for name, (select, needs) in _STATEMENTS.items()}
