a = 1
