"""Tables and paged files in, tables out."""
