"""Reading and writing: delimited text, typed JSON, configuration formats, containers, PDF, and what handles which file."""
