"""Source files that do not parse (problem 1): lexers, grammars, chart parser, repair."""
