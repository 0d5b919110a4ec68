"""riskloom.rules"""
