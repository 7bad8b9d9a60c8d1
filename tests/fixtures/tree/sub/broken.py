def broken(:
