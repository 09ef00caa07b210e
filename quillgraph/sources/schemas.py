"""Schemas of stored tables."""

MANIFEST = "arxiv_id string, title string, tex_dir string, pdf_file string, source_url string, pdf_url string"
SERVICE_PAPER = (
    "struct<paperId:string,externalIds:map<string,string>,title:string,abstract:string,year:int,venue:string,citationCount:bigint,referenceCount:bigint,"
    "influentialCitationCount:bigint,fieldsOfStudy:array<string>,authors:array<struct<authorId:string,name:string>>,tldr:struct<model:string,text:string>,openAccessPdf:struct<url:string,status:string>>"
)
REGISTRY = (
    "paper_id string, citation_key string, title string, authors array<string>, year string, arxiv_id string, doi string, url string, tex_dir string, pdf_file string, "
    f"source_kind string, download_mode string, has_local_tex boolean, has_local_pdf boolean, parse_status string, semantic_scholar {SERVICE_PAPER}"
)
NODES = "id string, labels array<string>, properties string"
EDGES = "source string, target string, rel_type string, properties string"
BIB = "path string, pos long, entry_type string, citation_key string, fields map<string,string>"
SECTION = "struct<level:int,title:string,content:string>"
PAPER = f"path string, title string, abstract string, sections array<{SECTION}>, figures array<string>, tables array<string>, citations array<string>"
DOCUMENT = f"path string, title string, authors array<string>, year string, kind string, sections array<{SECTION}>, citations array<string>"
NOTEBOOK = "path string, notebook_id string, kernel string, language string, cells array<struct<index:int,kind:string,source:string>>"
SYMBOL = "path string, module string, qualified_name string, name string, kind string, signature string, doc_summary string, line_start long, line_end long, parent string"
IMPORT = "path string, module string, target string, alias string, line long"
CALL = "path string, module string, caller string, target string, line long"
MEMORY = "path string, kind string, title string, section string, ordinal int, line_start long, line_end long, text string, supersedes array<string>"
