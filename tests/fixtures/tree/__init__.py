def init(): pass
