def kept():
    return 1
