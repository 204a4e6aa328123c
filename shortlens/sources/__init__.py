from shortlens.sources.files import (
    append_csv,
    from_json_col,
    from_rows,
    load,
    materialize,
    preview,
    read_payload_csv,
    read_urls,
    save,
    to_json_col,
    write_answers,
    write_lines,
)

__all__ = [
    "append_csv",
    "from_json_col",
    "from_rows",
    "load",
    "materialize",
    "preview",
    "read_payload_csv",
    "read_urls",
    "save",
    "to_json_col",
    "write_answers",
    "write_lines",
]
