z = 1
