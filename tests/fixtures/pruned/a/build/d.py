d = 1
