"""riskloom.streaming"""
