# only a comment
