"""Explicit schemas of all record kinds (Spark DDL); nothing is inferred."""

ARTICLE = (
    "slug string, title string, origTitle string, sourceUrl string, source string, date string, dateDisplay string, "
    "platforms array<string>, viewpoint string, theme string, thumbnail string, background string, bullets array<string>, "
    "cardBullets array<string>, meaning string, related array<struct<slug:string,title:string>>"
)
META = (
    "slug string, url string, sourceUrl string, platforms array<string>, viewpoint string, theme string, source string, "
    "date string, title string, bullets array<string>, thumbnail struct<type:string,url:string>"
)
META_COLUMNS = ["slug", "url", "sourceUrl", "platforms", "viewpoint", "theme", "source", "date", "title", "bullets", "thumbnail"]
_META_STRUCT = (
    "struct<slug:string,url:string,sourceUrl:string,platforms:array<string>,viewpoint:string,theme:string,source:string,"
    "date:string,title:string,bullets:array<string>,thumbnail:struct<type:string,url:string>>"
)
CATALOG = f"updatedAt string, articles array<{_META_STRUCT}>"
EVENT = (
    "type string, message struct<content:array<struct<type:string,name:string,text:string,"
    "input:struct<description:string,command:string,file_path:string,query:string,url:string>>>>, "
    "num_turns int, duration_ms bigint, is_error boolean, result string"
)
CANDIDATE = "url string, status int, corp_header string, og_image string, published date, lang string"

# Codes and labels that documents and messages show.
THEME_LABEL = {"visibility": "検索結果・購買導線の変化", "optimization": "商品情報・タグ付けの対策", "measurement": "計測・分析"}
PLATFORM_LABEL = {"google": "Google", "chatgpt": "ChatGPT", "rakuten": "楽天", "yahoo": "Yahoo!", "other-ai": "その他AI検索", "amazon": "Amazon"}
TOOL_LABEL = {
    "Bash": "コマンド実行", "Read": "ファイル読み込み", "Write": "ファイル作成", "Edit": "ファイル編集",
    "Glob": "ファイル検索", "Grep": "文字列検索", "WebFetch": "Webページ取得", "WebSearch": "Web検索",
}
REQUIRED = ["slug", "title", "sourceUrl", "source", "date", "background", "bullets", "cardBullets", "meaning", "thumbnail"]
CARD_BULLETS, CARD_WIDTH = 3, 55
FAILURE_MARK = r"NIGHTLY_RESEARCH_FAILED:\s*(.+)"
EOF_MARK = "自動リサーチが完了しました"
