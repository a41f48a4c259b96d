"""Struct types of the engine's tables, as DDL."""

from lodestar.functions.jsonld import DERIVED

LINK = "struct<url:string,href:string,anchor_text:string,name:string,rel:string,nofollow:boolean,target:string>"
HEADING = "struct<level:int,text:string>"
EXTRACTED = (
    "struct<title:string,meta_description:string,meta_robots:string,canonical:string,canonical_target:string,lang:string,charset:string,has_viewport_meta:boolean,"
    f"headings:array<{HEADING}>,links:array<{LINK}>,"
    "images:array<struct<src:string,alt:string,width:string,height:string,loading:string,has_srcset:boolean,alt_exempt:boolean>>,"
    "hreflang:array<struct<hreflang:string,url:string,href:string,target:string>>,json_ld:array<string>,json_ld_errors:int,"
    "json_ld_nodes:array<struct<types:array<string>,id:string,schema_context:boolean,json:string>>,"
    "open_graph:map<string,string>,twitter:map<string,string>,scripts:array<string>,inline_scripts:array<string>,"
    "script_tags:array<struct<src:string,text:string>>,stylesheets:array<string>,"
    "icons:array<struct<rel:string,url:string,sizes:string,type:string>>,"
    "media:array<struct<kind:string,src:string,poster:string,has_captions:boolean,has_track:boolean,has_fallback_text:boolean,ambient:boolean>>,"
    "frames:array<struct<src:string,title:string,loading:string>>,breadcrumbs:array<struct<links:array<string>,labels:array<string>,targets:array<string>>>,"
    f"comment_regions:array<struct<has_form:boolean,links:array<{LINK}>>>,"
    "tables:array<struct<rows:int,columns:int,has_headers:boolean,presentational:boolean>>,fragment_page_links:array<string>,landmarks:array<string>,"
    f"content:struct<root:string,sections:array<struct<heading:{HEADING},words:int>>,links:array<string>,text:string>,"
    "authorship:struct<meta_author:string,byline:string,article_author:string,published_time:string,modified_time:string,times:array<string>>,"
    f"derived:{DERIVED},"
    "text:string,word_count:int>"
)
FETCH = (
    "struct<requested_url:string,final_url:string,status:int,headers:map<string,string>,"
    "redirect_chain:array<struct<url:string,status:int,location:string>>,byte_length:bigint,truncated:boolean,content_type:string,error:string,body:string>"
)
RENDER = (
    f"struct<error:string,final_url:string,status:int,extracted:{EXTRACTED},largest_paint:struct<element:string,src:string,loading:string>,"
    "accessibility:struct<error:string,violations:array<struct<id:string,impact:string,nodes:int>>>,requests:array<string>>"
)
PAGES = (
    "crawl_id string, ordinal int, url string, normalized_url string, depth int, discovered_from string, "
    f"fetch {FETCH}, extracted {EXTRACTED}, rendered {RENDER}, rendered_mobile {RENDER}"
)
SITES = (
    "crawl_id string, origin string, crawled_at timestamp, environment string, flags array<string>, robots_txt string, robots_status int, robots_error string, "
    "protocol struct<alpn:string,tls_version:string,error:string>, "
    "rdap struct<domain:string,registrar:string,expires_at:string,fetched_at:timestamp,statuses:array<string>,error:string>, "
    "ai_policy map<string,string>, production_origin string, settings string, release_id string"
)
SITEMAPS = "crawl_id string, url string, status int, url_count bigint, video_count bigint, news_count bigint, truncated boolean, fetched_at timestamp, declared boolean"
SITEMAP_URLS = "crawl_id string, url string, normalized_url string"
SITEMAP_NEWS = "crawl_id string, sitemap string, loc string, publication_name string, language string, publication_date string, title string"
SITEMAP_VIDEO = "crawl_id string, sitemap string, loc string, title string, description string, thumbnail_url string, content_url string, player_url string"
AUXILIARY = f"crawl_id string, reason string, url string, agent string, fetch {FETCH}"
URLS = "crawl_id string, url string"
OBSERVATIONS = "crawl_id string, probe_id string, scope string, page_url string, outcome string, summary string, data string"
PREVIOUS_PAGES = (
    "crawl_id string, url string, status int, final_url string, meta_robots string, x_robots_tag string, canonical string, title string, h1 string, words int, "
    "json_ld_types array<string>, hreflang array<struct<hreflang:string,url:string>>, axe array<struct<id:string,impact:string,nodes:int>>"
)
PREVIOUS_PROBES = "crawl_id string, probe_id string, page_url string, outcome string"
GATES = "crawl_id string, passed_before array<string>, failing_now array<string>, reopened array<string>"
CHECK_STATES = (
    "crawl_id string, check_id string, applicability string, applicability_rationale string, status string, coverage string, basis string, "
    "evidence string, evidence_ref string, attestation_expires_at timestamp"
)
CHECKS = "version string, id string, title string, phase int, launch_gate boolean, automation string, universal boolean, flags array<string>, detectors array<string>, priority string"
REVIEW_RUNS = (
    "site_id string, run_id string, check_id string, release_id string, scope_revision string, criteria_revision string, origin string, environment string, "
    "tested_at timestamp, tester string, result string, evidence string, reviewed_by string, reviewed_at timestamp, next_review_at timestamp, event_trigger string"
)
HELD = "crawl_id string, owner string, recorded_at timestamp, next_review_at timestamp"
#: lists of sections that grow with a site's traffic (place: where a row stands)
LONG = {
    "server_logs.hits": "crawl_id string, at timestamp, method string, path string, status int, user_agent string, parameterised boolean",
    "search_console.performance": "crawl_id string, place long, page string, query string, clicks double, impressions double, period string",
    "index_now.log": "crawl_id string, url string, sent_at timestamp, status int",
}
#: person-supplied records; each has HELD's columns first
INPUTS = {
    "a11y_evaluation": "scope string, methods array<string>, limitations string, conformance_claim string, blockers array<struct<criterion:string,url:string,resolved:boolean>>",
    "ai_baseline": "entries array<struct<engine:string,period:string,available_from:string>>",
    "analytics": (
        "measurement_ids array<string>, consent_default string, events array<struct<name:string,status:string,trigger:string,owner:string,trigger_url:string>>, "
        "reported array<struct<metric:string,a:double,b:double,explanation:string>>"
    ),
    "bing": "verified boolean, sitemaps array<struct<url:string,status:string>>",
    "brand": "names array<string>, profiles array<string>",
    "canary": "urls array<string>, target_minutes double, recipient string, last_test_alert_at timestamp, delivered_at timestamp",
    "checkout": "cases array<struct<name:string,url:string,result:string>>",
    "ci_guard": "caught array<string>, clean_passed boolean",
    "ci_rules": "rules array<struct<name:string,owner:string,severity:string,false_positive_rate:double>>",
    "competitors": "entries array<struct<keyword:string,competitor:string,rank:int,url:string>>",
    "content_decisions": "entries array<struct<url:string,decision:string>>",
    "content_review": "entries array<struct<url:string,verdict:string>>",
    "crux": (
        "populations array<struct<source:string,target:string,form_factor:string,lcp_ms:double,inp_ms:double,cls:double,actions:array<struct<metric:string,owner:string>>>>"
    ),
    "digital_pr": "wins array<struct<url:string,paid:boolean,owner:string>>",
    "disavow": "submitted boolean, reasons string, attempts string",
    "domain_history": "checks array<struct<kind:string,resolved:boolean,issue:string>>",
    "environments": "entries array<struct<name:string,url:string,kind:string>>",
    "experiments": "entries array<struct<name:string,variants:array<string>,retire_by:timestamp>>",
    "gbp": "eligible boolean, status string, locations array<struct<url:string,name:string,address:string,phone:string>>",
    "incidents": "entries array<struct<id:string,owner:string,remediation:string>>, test_interval_days int",
    "index_now": "key string, key_location string, log array<struct<url:string,sent_at:timestamp,status:int>>",
    "keyword_map": "entries array<struct<url:string,keyword:string>>",
    "lighthouse": (
        "reports array<struct<url:string,read:boolean,test_profile:string,fetched_at:timestamp,metrics:map<string,double>,"
        "lcp_element:struct<tag:string,src:string,loading:string,fetch_priority:string>>>, "
        "policy struct<test_profile:string,revision:timestamp,owner:string,thresholds:map<string,double>>"
    ),
    "merchant_feed": "items array<struct<id:string,link:string,price:double,currency:string,availability:string,gtin:string,brand:string>>",
    "redirect_map": "kind string, old_origin string, entries array<struct<from:string,expect:int,to:string>>",
    "reporting": "thresholds array<struct<metric:string,engine:string,change:double>>, anomalies array<struct<metric:string,engine:string,period:string,disposition:string>>",
    "review_destinations": "entries array<struct<url:string,owner:string,next_check_at:timestamp>>",
    "search_console": (
        "properties array<struct<property:string,owners:array<string>>>, sitemaps array<struct<url:string,status:string,errors:int>>, "
        "inspections array<struct<url:string,verdict:string,robots:string,indexing:string,google_canonical:string,coverage:string>>, "
        "performance array<struct<page:string,query:string,clicks:double,impressions:double,period:string>>, "
        "indexation array<struct<url:string,reason:string>>, manual_actions array<string>, security_issues array<string>, issues_checked_at timestamp"
    ),
    "server_logs": "hits array<struct<at:timestamp,method:string,path:string,status:int,user_agent:string,parameterised:boolean>>",
    "url_matrix": "entries array<struct<pattern:string,priority:boolean,status:int,indexable:boolean,canonical:string,in_sitemap:boolean,access:string,environment:string>>",
    "vulnerabilities": "entries array<struct<id:string,severity:string,owner:string,fixed_at:timestamp>>",
}
