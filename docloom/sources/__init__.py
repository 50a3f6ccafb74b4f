"""File sources on the standard library: text encodings, media headers, workbooks, word documents."""
